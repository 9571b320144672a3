"""Names of files and folders: extensions, categories, priorities, collapse and prune rules of a folder tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and extensions that decide what a tree shows.
COMPOUND = [".db-shm", ".db-wal", ".tar.gz", ".tar.xz", ".tar.bz2"]
CATEGORIES = {
    "image": ".avif .bmp .gif .heic .heif .ico .jfif .jpeg .jpg .png .psd .raw .svg .tif .tiff .webp".split(),
    "video": ".3gp .avi .flv .m2ts .m4v .mkv .mov .mp4 .mpeg .mpg .mts .ogv .webm .wmv".split(),
    "audio": ".aac .aiff .alac .flac .m4a .mid .midi .mp3 .oga .ogg .opus .wav .wma".split(),
    "font": ".eot .otf .ttc .ttf .woff .woff2".split(),
    "archive": ".7z .bz2 .cab .gz .iso .rar .tar .tar.bz2 .tar.gz .tar.xz .tbz2 .tgz .txz .xz .zip .zst".split(),
    "binary": ".a .aab .apk .appimage .bin .deb .dll .dylib .exe .lib .msi .o .obj .pdb .rpm .so .wasm".split(),
    "database": ".db .db-shm .db-wal .sqlite .sqlite3".split(),
    "dataset": ".arrow .csv .feather .npy .npz .parquet .pickle .pkl".split(),
    "document": ".doc .docm .docx .epub .odf .odg .odp .ods .odt .pdf .ppt .pptm .pptx .rtf .xls .xlsb .xlsm .xlsx".split(),
    "model": ".ckpt .gguf .onnx .pt .pth .safetensors".split(),
    "log": ".log .trace".split(),
}
REPETITIVE = ["archive", "audio", "binary", "database", "dataset", "font", "image", "log", "model", "video"]
STRUCTURAL = (
    ".asm .astro .bat .c .cc .cfg .cjs .clj .cljs .cmd .conf .cpp .cs .css .cu .cuh .dart .env .fish .fs .fsx .glsl .go .graphql .groovy .h .handlebars .hbs .hh .hook .hpp .htm .html .ini .java .jinja .jinja2 .jl .js .json "
    ".json5 .jsonc .jsx .kt .kts .less .lua .m .md .mdx .mjs .mm .mustache .php .pl .pm .proto .ps1 .psd1 .psm1 .py .pyi .r .rb .rs .sass .scala .scss .sh .sql .svelte .swift .tex .tf .tfvars .toml .ts .tsx .txt .vue .xml .yaml .yml .zsh"
).split()
SPECIAL = (
    ".dockerignore .editorconfig .env .gitattributes .gitignore .npmrc .prettierignore .prettierrc .python-version .treeignore agents.md architecture.md cargo.lock cargo.toml changelog changelog.md claude.md cmakelists.txt codeowners "
    "compose.yaml compose.yml containerfile dockerfile gemfile go.mod go.sum justfile license license.md makefile manifest.json package-lock.json package.json pnpm-lock.yaml poetry.lock pyproject.toml readme readme.md requirements.txt "
    "system_context.yaml tsconfig.json yarn.lock"
).split()
SPECIAL_STARTS = ["readme", "license", "changelog", "requirements", ".env"]
COLLAPSED = (
    ".git .hg .svn .cache .mypy_cache .pytest_cache .ruff_cache .tox .venv __pycache__ bower_components build dist node_modules target venv .eggs .gradle .next .nuxt .parcel-cache .pnpm-store .svelte-kit .turbo coverage htmlcov"
).split()
COLLAPSED_ENDS = [(".claude", "worktrees"), (".codex", "worktrees"), (".agents", "worktrees")]
PRIORITY_FOLDERS = (
    ".agents .claude .codex addons ai-stack blueprints pyscript script-modules script-opts shaders app apps assets bin cards client components config configs custom_components docs documentation include lib modules packages plugins public "
    "scripts server skills src source templates test tests themes ui views www"
).split()
PROTECTED_FOLDERS = [*PRIORITY_FOLDERS, "base", "core", "hooks", "rules"]
LOW_VALUE_FOLDERS = (
    "archive archives backup backups cache caches downloads example examples fixtures fonts generated images image logs media recordings reports snapshots temp temporary third_party thumbnails thumbnail tmp transcripts vendor"
).split()


def extension(name: Column) -> Column:
    """The lower-case extension with its dot, compound ones whole; empty where there is none (a leading dot starts none)."""
    low = F.lower(name)
    out = F
    for c in COMPOUND:
        out = out.when(low.endswith(c), F.lit(c))
    return out.otherwise(F.regexp_extract(low, r"[^.](\.[^.]+)$", 1))


def category(name: Column) -> Column:
    """The first category that holds the name's extension, or an empty text."""
    table = {e: c for c, es in reversed(CATEGORIES.items()) for e in es}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), extension(name)), F.lit(""))


def priority(name: Column) -> Column:
    """3 for names that describe a project, 2 for structural extensions, 1 for uncategorised files, 0 for bulk."""
    low = F.lower(name)
    special = low.isin(*SPECIAL)
    for s in SPECIAL_STARTS:
        special = special | low.startswith(s)
    return F.when(special, 3).when(extension(name).isin(*STRUCTURAL), 2).when(category(name) == "", 1).otherwise(0)


def is_collapsed(path: Column) -> Column:
    """Whether a folder (segments of its path) is shown without its contents: by its name, or by the end of its path."""
    low = F.transform(path, lambda s: F.lower(s))
    out = F.coalesce(F.try_element_at(low, F.lit(-1)).isin(*COLLAPSED), F.lit(False))
    for ends in COLLAPSED_ENDS:
        n = len(ends)
        out = out | ((F.size(low) >= n) & (F.when(F.size(low) >= n, F.slice(low, -n, n)) == F.array(*map(F.lit, ends))))
    return out


def prune_tier(path: Column) -> Column:
    """In which of ten rounds a folder (segments of its path) gives up its contents when a tree is too long."""
    low, depth = F.transform(path, lambda s: F.lower(s)), F.size(path)
    cheap = F.arrays_overlap(low, F.array(*map(F.lit, LOW_VALUE_FOLDERS)))
    kept = F.coalesce(F.try_element_at(low, F.lit(-1)).isin(*PROTECTED_FOLDERS), F.lit(False))
    out = F.when(cheap, F.when(depth >= 2, 0).when(depth == 1, 1).otherwise(9))
    return F.coalesce(out, F.when(~kept, F.when(depth >= 4, 2).when(depth == 3, 3).when(depth == 2, 4).when(depth == 1, 8)).otherwise(F.when(depth >= 4, 5).when(depth == 3, 6).when(depth == 2, 7)), F.lit(9))


def ignored_event(path: Column, outputs: list[str]) -> Column:
    """Whether a change event is of no interest: playlists, caches and the outputs themselves."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return name.rlike(r"\.m3u8?$") | name.rlike(r"(^|[._-])cache\.json$") | F.lower(path).isin(*[o.lower() for o in outputs])


def glob_pattern(glob: str) -> str:
    """A file-name glob (``*``, ``?``) as an anchored regular expression in any case."""
    import re

    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def kept_by_globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a file's name fits an include glob and neither its name nor a folder on its path fits an exclude glob."""
    parts = F.split(path, r"[/\\]")
    name = F.try_element_at(parts, F.lit(-1))
    fits = F.lit(not include)
    for g in include:
        fits = fits | name.rlike(glob_pattern(g))
    barred = "|".join(f"(?:{glob_pattern(g)})" for g in exclude)
    return fits & ~F.exists(parts, lambda p: p.rlike(barred)) if exclude else fits


def folder_first(is_folder: Column, name: Column) -> list[Column]:
    """Sort columns of a folder's entries: folders before files, names in any case."""
    return [is_folder.desc(), F.lower(name).asc()]
