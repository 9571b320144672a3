"""Predicates, orders and identities of a library of found files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.markup import normalised_text

# Failures after which a stronger transport is tried, extensions by type, the order of match kinds.
ESCALATING = ["http_401", "http_403", "network_error", "timeout", "wrong_magic", "html_response", "zero_bytes", "implausible_size", "redirected_away", "mime_mismatch", "download_interrupted"]
KINDS = ["exact", "pixel", "variant"]


def passes_filter(kind: Column, state: Column, width: Column, height: Column, wanted: str = "all", hide_done: bool = False, least_edge: int = 0) -> Column:
    """Whether an item is shown plainly: of the wanted kind, not done if those are hidden, and not known to be too small."""
    edge = F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)))
    out = F.lit(True) if wanted == "all" else F.coalesce(kind == wanted, F.lit(False))
    if hide_done:
        out = out & ~F.coalesce(state == "done", F.lit(False))
    return out & ~((edge > 0) & (edge < least_edge))


def library_order(mode: str, width: Column, height: Column, size: Column, added: Column, confidence: Column, label: Column) -> list[Column]:
    """Sort columns of a mode: bytes, added, confidence, name, or the area by default; unknown counts as nothing."""
    area = F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0))
    modes = {"bytes": F.coalesce(size, F.lit(0)).desc(), "added": added.desc(), "confidence": confidence.desc(), "name": F.lower(F.coalesce(label, F.lit(""))).asc()}
    return [modes.get(mode, area.desc())]


def escalates(code: Column) -> Column:
    return F.coalesce(code.isin(*ESCALATING), F.lit(False))


def location(original_valid: Column, quarantine_valid: Column) -> Column:
    """Where a moved file is, from whether either place holds it unchanged."""
    return F.when(original_valid & quarantine_valid, "ambiguous_both").when(original_valid, "original").when(quarantine_valid, "quarantine").otherwise("missing_or_changed")


def ids_are_sound(ids: Column, most: int = 10_000) -> Column:
    """A list of ids that is not empty, not too long and without repeats."""
    return F.coalesce((F.size(ids) > 0) & (F.size(ids) <= most) & (F.size(F.array_distinct(ids)) == F.size(ids)), F.lit(False))


def is_recent(ts: Column, now: Column, ttl: int) -> Column:
    return F.coalesce((ts > 0) & (now - ts < ttl), F.lit(False))


def monitor_id(device: Column) -> Column:
    """The second part of a device path between backslashes, else its first 12 characters."""
    return F.coalesce(F.nullif(F.get(F.split(device, r"\\"), F.lit(1)), F.lit("")), F.substring(device, 1, 12))


def invocation_signature(direction: Column, paths: Column) -> Column:
    """SHA-256 of a direction and a set of paths, in any order and case."""
    return F.sha2(F.concat_ws("\n", direction, F.array_join(F.array_sort(F.transform(paths, lambda p: F.upper(p))), "\n")), 256)


def same_element(a_id: Column, b_id: Column, a_data: Column, b_data: Column, a_text: Column, b_text: Column) -> Column:
    """Whether b is the page element that signature a was made of: an equal id, an equal data attribute, or a label that begins
    with the first 20 characters of a's, each enough by itself; what the signature lacks says nothing."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    prefix = F.substring(normalised_text(a_text), 1, 20)
    return F.coalesce(there(a_id) & (a_id == b_id), F.lit(False)) | F.coalesce(there(a_data) & (a_data == b_data), F.lit(False)) | F.coalesce(there(prefix) & normalised_text(F.coalesce(b_text, F.lit(""))).startswith(prefix), F.lit(False))


def orientation_by_content(horizontal: Column, vertical: Column, frames: Column, least: float = 0.6) -> Column:
    """The side that enough frames vote for, else null: a decision from votes."""
    share = lambda v: F.try_divide(v.cast("double"), frames.cast("double"))
    return F.when((share(horizontal) >= least) & (horizontal > vertical), "horizontal").when((share(vertical) >= least) & (vertical > horizontal), "vertical")


def is_video_request(url: Column, mime: Column) -> Column:
    """Whether a request is for video, by type, extension or manifest."""
    from millrace.functions import mime as types

    return F.coalesce(types.kind_of(mime).isin("video", "stream"), F.lit(False)) | F.coalesce(url, F.lit("")).rlike(types.VIDEO_URL) | types.is_manifest(url, mime)
