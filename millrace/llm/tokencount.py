"""Unigram token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a slice of texts are inserted in a trie, level by level. A node is a prefix; its forward score
is the best log score of a segmentation of that prefix into vocabulary pieces, computed once however many pre-tokens share
it, from its parent: at each node the paths in the trie of pieces that are still open there are known, with the scores of
the nodes where they began, and the node's character carries them on. All nodes of a level are computed together, as
arrays. Terminal nodes yield their pre-token's count, which is stored, so a document's count is a sum of look-ups.

Pieces are those of a vocabulary file. A unigram file has log probabilities and they are used as they are. A BPE file has
only merge ranks, so its pieces are scored by Zipf's law, as -log(rank + 2); nothing is trained. The counts are then those
of a unigram model over that vocabulary, not those of the file's own merges.
"""

from __future__ import annotations

from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.text import map_texts

#: Pre-tokens whose counts a worker keeps; characters of a pre-token that goes into the trie (a longer one shares nothing
#: worth keeping and is scored by the same steps alone); characters of a text that are split at once.
REMEMBERED, LONG, PIECE = 250_000, 48, 1 << 20
#: Fixed value: the character that stands for the space before a word.
MARK = "▁"


class Unigram:
    """Pieces with scores; a character that no piece covers costs its UTF-8 bytes as tokens, at a score below all."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.floor = min(scores.values(), default=0.0) - 10.0
        # the trie of pieces: where (node, character) leads, and the score of the piece that ends at a node, if one does
        self.next: dict[int, int] = {}
        ends = [np.nan]
        for piece, score in scores.items():
            at = 0
            for c in piece:
                to = self.next.setdefault(at << 21 | ord(c), len(ends))
                if to == len(ends):
                    ends.append(np.nan)
                at = to
            ends[at] = score
        self.ends = np.array(ends)
        keys = np.array(list(self.next), np.int64)
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.to = np.r_[np.array(list(self.next.values()), np.int64)[order], 0]
        self.forget()

    @classmethod
    def load(cls, path: str) -> Unigram:
        """A sentencepiece file; control, unknown, byte and unused pieces are no pieces of text."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        scores = {p.id_to_piece(i): p.get_score(i) for i in plain}
        if all(s == int(s) for s in scores.values()):  # ranks
            scores = {t: -log(2.0 - s) for t, s in scores.items()}
        return cls(scores)

    def _alone(self, word: str) -> tuple[int, float]:
        """(tokens, score) of one pre-token, a step a character."""
        best, n, paths, ends = 0.0, 0, [], self.ends
        for c in word:
            top, count, still = best + self.floor, n + len(c.encode("utf-8", "surrogatepass")), []
            for at, score, tokens in (*paths, (0, best, n + 1)):
                to = self.next.get(at << 21 | ord(c))
                if to is not None:
                    still.append((to, score, tokens))
                    if (total := score + ends[to]) > top or (total == top and tokens < count):
                        top, count = total, tokens
            best, n, paths = float(top), count, still
        return n, best

    def insert(self, words: list[str]) -> None:
        """Store the counts of the given distinct pre-tokens, without their MARK and shorter than LONG."""
        words = sorted(words)
        size = np.array([len(w) + 1 for w in words], np.int64)
        points = np.zeros((len(words), int(size.max()) + 1), np.int64)
        points[np.arange(points.shape[1]) < size[:, None]] = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        shared = np.r_[0, (points[1:] != points[:-1]).argmax(1)]  # characters that a word shares with the one before
        out_score, out_n = np.zeros(len(words)), np.zeros(len(words), np.int64)
        place = np.zeros(len(words), np.int64)  # each word's node on the level above
        best, n = np.zeros(1), np.zeros(1, np.int64)
        # the open paths of the level above, in the order of its nodes: how many a node has, states, scores and tokens
        many, state, score, tokens = np.ones(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.ones(1, np.int64)
        for depth in range(1, points.shape[1]):
            live = np.flatnonzero(size >= depth)
            if not len(live):
                break
            # a node begins at each word that is the first with its prefix
            first = np.minimum.reduceat(shared, np.r_[0, live[:-1] + 1])[: len(live)] if len(live) < len(words) else shared
            new = first < depth
            new[0] = True
            node = np.cumsum(new) - 1
            reps = live[new]
            parent, c = place[reps], points[reps, depth - 1]
            # every child carries on all paths of its parent
            k = many[parent]
            child = np.repeat(np.arange(len(reps)), k)
            begin = np.cumsum(many) - many
            at = np.arange(len(child)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[parent], k)
            key = state[at] << 21 | c[child]
            slot = np.searchsorted(self.keys, key)
            hit = self.keys[slot] == key
            child, at, state = child[hit], at[hit], self.to[slot[hit]]
            score, tokens = score[at], tokens[at]
            top, count = best[parent] + self.floor, n[parent] + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            total = score + self.ends[state]
            whole = ~np.isnan(total)
            w, t, m = child[whole], total[whole], tokens[whole]
            ahead = top.copy()
            np.maximum.at(ahead, w, t)
            count[ahead > top] = np.iinfo(np.int64).max
            tie = t == ahead[w]
            np.minimum.at(count, w[tie], m[tie])
            best, n = ahead, count
            place[live] = node
            ended = live[size[live] == depth]
            out_score[ended], out_n[ended] = best[place[ended]], n[place[ended]]
            # a path may begin behind every node
            many = np.bincount(child, minlength=len(reps)) + 1
            spot = np.cumsum(many) - 1
            old = np.ones(len(child) + len(reps), bool)
            old[spot] = False
            parts = []
            for kept, fresh in ((state, 0), (score, best), (tokens, n + 1)):
                x = np.empty(len(old), kept.dtype)
                x[old], x[spot] = kept, fresh
                parts.append(x)
            state, score, tokens = parts
        self._store(words, out_n, out_score)

    def count(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, score) of each whole text."""
        split = [[w for part in _parts(t) for w in part.split()] if t and len(t) > PIECE else (t or "").split() for t in texts]
        if len(self.terminal) > REMEMBERED:
            self.forget()
        new = set().union(*split) - self.terminal.keys()
        long = [w for w in new if len(w) >= LONG]
        if short := list(new.difference(long)):
            self.insert(short)
        kept = len(self.tokens)
        if long:
            self._store(long, *zip(*(self._alone(MARK + w) for w in long), strict=True))
        out = []
        for words in split:
            at = np.fromiter(map(self.terminal.__getitem__, words), np.int64, len(words))
            out.append((len(words), int(self.tokens[at].sum()), float(self.score[at].sum())))
        for w in long:
            del self.terminal[w]
        self.tokens, self.score = self.tokens[:kept], self.score[:kept]
        return out

    def _store(self, words, tokens, score) -> None:
        self.terminal.update(zip(words, range(len(self.tokens), len(self.tokens) + len(words)), strict=True))
        self.tokens, self.score = np.r_[self.tokens, np.array(tokens, np.int64)], np.r_[self.score, np.array(score, float)]

    def forget(self) -> None:
        """Drop what terminals have stored: a place for each pre-token, and counts and scores by place."""
        self.terminal: dict[str, int] = {}
        self.tokens, self.score = np.empty(0, np.int64), np.empty(0)


def _parts(text: str):
    """The text cut at white space into pieces of about PIECE characters."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


_models: dict[str, Unigram] = {}


def model(path: str) -> Unigram:
    """The worker's model of a file, loaded once."""
    if path not in _models:
        _models[path] = Unigram.load(path)
    return _models[path]


def _forget() -> None:
    for m in _models.values():
        m.forget()


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_pretokens, n_tokens and the log score of each whole text's best segmentation, in
    place of columns of these names.

    Pre-tokens are runs of characters between white space. Null and empty texts have none. Repeated rows give repeated
    results; an empty table gives an empty one; the other columns stay as they are. Of segmentations with equal scores one
    with fewer tokens counts.
    """

    def count(texts):
        found = model(path).count(texts.to_pylist())
        return [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]

    return map_texts(docs, text, count, {"n_pretokens": "long", "n_tokens": "long", "log_score": "double"}, drop=(text,), done=_forget)
