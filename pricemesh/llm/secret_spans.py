"""Secrets by rules and by a linear-chain conditional random field over tokens.

The rules (assignments, access key ids, long hex) always count. The field tags every token of a text, whatever its
letters, as outside (O), begin (B) or inside (I) of a secret from its shape, the words around it and features of the
whole text, and is decoded by Viterbi. Scores of all tokens are array sums; a bound on what any run of B and I can gain
over O names the few stretches where the best path may leave O, and only these are followed token by token. That is
exact: outside of them no path gains anything.

There are no hand-made labels: the field learns from what the rules find. The bounds of training are TRAIN_HITS windows
around rule hits, picked by hash from the hits of all texts, and TRAIN_PLAIN windows of texts picked by hash, each
weighing as many windows as it stands for, so hits keep the share they have in the corpus. Every window is also shown
without its neighbouring words and without its shapes, and every hit with its value replaced by letters, by digits and
by parts with a sign between, so that a word, a number or a punctuated text in a secret's place is one.
Null text counts as empty; repeated rows get equal spans; without any rule hit the field adds nothing.
Texts of any length are read whole, an empty table gives no rows, and only doc_id and text are read, so other columns may
have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pricemesh import staging
from pricemesh.llm import blocks

TRAIN_HITS = 200
TRAIN_PLAIN = 400
#: Texts from which the plain windows come, tokens of a window, and how many of a text's windows one stands for at most.
TRAIN_TEXTS = 2_000
PIECE = 32
STRIDE = 16
#: Tokens shown on either side of a hit, and looked back over for a hint.
MARGIN = 8
CONTEXT = 4
#: Distinct tokens remembered by a task.
REMEMBERED = 200_000
KINDS = ("assign", "access", "hex", "crf")
TAGS = ("O", "B", "I")

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A token with the white space behind it; all tokens of a text together are the text, but for white space before them.
_TOKEN = re.compile(r"(?:[\w+/.-]+={0,2}|[^\w\s])\s*")
_HINTS = re.compile(r"pass|pwd|secret|token|key|auth|bearer|cred|login|private|access")
_NEAR = (-3, -2, -1, 1, 2)
_SIGNS = "@#!$%&*"

Span = tuple[int, int, str]


def rule_spans(text: str) -> list[Span]:
    """What the rules find: (start, end, kind), ordered by start, then kind."""
    spans: list[Span] = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        # A match that is too short still uses up its text, so it is found first and dropped after.
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _values(text: str) -> list[tuple[int, int]]:
    """The secret parts of what the rules find: values without their names."""
    found = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [m.span() for rule in (_ACCESS, _HEX) for m in rule.finditer(text)]
    return sorted(found)


def tokens_of(text: str) -> tuple[list[str], int]:
    """The tokens of a text and where the first begins."""
    start = len(text) - len(text.lstrip())
    return _TOKEN.findall(text, start), start


def _class(token: str) -> str:
    """What neighbours see of a token."""
    if len(token) == 1 and not token.isalnum():
        return token
    hint = "hint" if len(token) <= 32 and _HINTS.search(token.lower()) else ""
    return hint + "=" if token.endswith("=") else hint


def _traits(token: str) -> tuple:
    """What the shape of a token is judged by; None for a single sign."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return (None,)
    try:
        kinds = token.encode("latin-1").translate(_KINDS_OF)
    except UnicodeEncodeError:
        kinds = bytes(map(_kind, token))
    digits = kinds.count(b"0")
    return (
        min(8, n // 3), b"A" in kinds, b"a" in kinds, digits * 4 // n, min(5, (len(_RUN.findall(kinds)) - 1) * 8 // n),
        n >= 8 and not token.strip("0123456789abcdefABCDEF"), token[:4] if n >= 16 and token[:4].isupper() else "-",
        min(5, len(set(token)) // 4),
    )


def _kind(c: str) -> int:
    return ord("0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "-")


_KINDS_OF = bytes(_kind(chr(k)) for k in range(256))
_RUN = re.compile(rb"0+|A+|a+|-+")
_TRAITS = ("length", "upper", "lower", "digits", "turns", "hex", "head", "distinct")


def _shape(token: str) -> list[str]:
    traits = _traits(token)
    return ["sign"] if traits[0] is None else [f"{name} {x}" for name, x in zip(_TRAITS, traits)]


def _text_features(text: str) -> list[str]:
    marks = sum(text.count(c) for c in "={};")
    return [f"file code {min(4, int(marks * 200 / max(1, len(text))))}", f"file lines {min(4, (text.count(chr(10)) + 1).bit_length() // 2)}"]


def around(tokens: list[str], i: int) -> list[str]:
    """Features of a token's neighbours, and whether it stands directly behind the one before."""
    out = [f"near {d} {c}" for d in _NEAR if 0 <= i + d < len(tokens) and (c := _class(tokens[i + d].rstrip()))]
    hint = any(_class(t.rstrip()).startswith("hint") for t in tokens[max(0, i - CONTEXT) : i])
    return [*out, f"hint before {hint}", f"glued {i > 0 and not tokens[i - 1][-1].isspace()}"]


class Field(NamedTuple):
    """weights: a row per feature and one for unknown ones, a column per tag; steps: tag to tag."""

    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray


class Example(NamedTuple):
    """A window of tokens to learn from: features of each by shape and surroundings, those of its file, its tags."""

    shapes: list[list[str]]
    around: list[list[str]]
    whole: list[str]
    tags: list[int]
    weight: float = 1.0
    made: bool = False  # a hit whose value was replaced


_STATES = (0, 1, 2)


class Decoder:
    """Scores of B and I over O, as arrays over the tokens of a text, and the best path."""

    def __init__(self, field: Field):
        self.index = field.index
        self.weights = (field.weights - field.weights[:, :1])[:, 1:]
        # Steps as gains over staying at O; nothing goes on inside what has not begun.
        self.steps = field.steps - field.steps[0, 0]
        self.steps[0, 2] = -np.inf
        classes = sorted({f.split(" ", 2)[2] for f in field.index if f.startswith("near ")})
        self.classes = {c: k for k, c in enumerate(["", *classes])}
        self.near = np.zeros((len(_NEAR), len(self.classes), 2))
        for f, k in field.index.items():
            if f.startswith("near "):
                _, d, c = f.split(" ", 2)
                self.near[_NEAR.index(int(d)), self.classes[c]] = self.weights[k]
        self.hint, self.glue = (np.array([self._sum([f"{f} {x}"]) for x in (False, True)]) for f in ("hint before", "glued"))
        enter, stay = self.steps[:, 1].max(), self.steps[1:, 2].max()
        self.bound = enter, stay, max(0.0, *self.steps[1:, 0])
        self._forget()

    def _sum(self, features: list[str]) -> np.ndarray:
        return sum((self.weights[self.index[f]] for f in features if f in self.index), np.zeros(2))

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.of_traits: dict[tuple, np.ndarray] = {}
        self.gain, self.facts = np.zeros((1024, 2)), np.zeros((1024, 3), np.int64)

    def _id(self, token: str) -> int:
        k = self.ids[token] = len(self.ids)
        if k == len(self.gain):
            self.gain, self.facts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.gain, self.facts))
        bare = token.rstrip()
        c = _class(bare)
        traits = _traits(bare)
        if traits not in self.of_traits:
            self.of_traits[traits] = self._sum(_shape(bare))
        self.gain[k] = self.of_traits[traits]
        self.facts[k] = self.classes.get(c, 0), c.startswith("hint"), len(bare) == len(token)
        return k

    def scores(self, tokens: list[str], whole: list[str]) -> np.ndarray:
        """A row per token: what B and I score over O."""
        if len(self.ids) > REMEMBERED:
            self._forget()
        known = self.ids.get
        ids = np.array([k if (k := known(t)) is not None else self._id(t) for t in tokens], np.int64)
        n = len(ids)
        out = self.gain[ids] + self._sum(whole)
        facts = self.facts[ids]
        seen = np.zeros(n + 5, np.int64)
        seen[3 : n + 3] = facts[:, 0]
        for k, d in enumerate(_NEAR):
            out += self.near[k][seen[3 + d : n + 3 + d]]
        hints = np.concatenate([np.zeros(CONTEXT + 1, np.int64), np.cumsum(facts[:, 1])])
        out += self.hint[(hints[CONTEXT : n + CONTEXT] > hints[:n]).astype(np.int64)]
        out += self.glue[np.concatenate([[0], facts[:-1, 2]])]
        return out

    def stretches(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Where a run of B and I may gain: everywhere else O is best. A run's gain is at most the sum of `most` over
        it, so a token outside every run of positive sum is in none that gains."""
        enter, stay, leave = self.bound
        most = np.maximum(scores[:, 0] + enter, scores[:, 1] + stay) + leave
        most[0] = max(most[0], scores[0, 0] + leave)
        if not (most > 0).any():
            return []
        upto = np.concatenate([[0.0], np.cumsum(most)])
        lowest = np.minimum.accumulate(upto[:-1])
        highest = np.maximum.accumulate(upto[:0:-1])[::-1]
        live = np.concatenate([[False], highest - lowest > -1e-6, [False]])
        edges = np.flatnonzero(live[1:] != live[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist()))

    def path(self, scores: np.ndarray, first: bool, last: bool) -> list[int]:
        """The best tags of a stretch between tokens tagged O, or at the text's first or last token."""
        if len(scores) == 1 and not first and not last:
            return [int(scores[0, 0] + self.steps[0, 1] + self.steps[1, 0] > 0)]
        steps = self.steps.tolist()
        rows = [(0.0, b, i) for b, i in scores.tolist()]
        begin = (0.0, 0.0, -np.inf) if first else steps[0]
        best = [x + y for x, y in zip(begin, rows[0])]
        back = []
        for row in rows[1:]:
            # Of equal ways the one with the smaller tag stands.
            pointers = [max(_STATES, key=lambda p: best[p] + steps[p][q]) for q in _STATES]
            best = [best[p] + steps[p][q] + row[q] for q, p in enumerate(pointers)]
            back.append(pointers)
        ends = best if last else [x + steps[p][0] for p, x in enumerate(best)]
        tags = [max(_STATES, key=ends.__getitem__)]
        for pointers in reversed(back):
            tags.append(pointers[tags[-1]])
        return tags[::-1]

    def tags(self, scores: np.ndarray) -> dict[int, int]:
        """The tags other than O of the best path, by token."""
        found: dict[int, int] = {}
        for a, b in self.stretches(scores):
            found.update({a + i: t for i, t in enumerate(self.path(scores[a:b], a == 0, b == len(scores))) if t})
        return found

    def spans(self, text: str) -> list[Span]:
        """Secrets that the field sees."""
        tokens, start = tokens_of(text)
        if not tokens:
            return []
        tags = self.tags(self.scores(tokens, _text_features(text)))
        if not tags:
            return []
        starts = start + np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        spans: list[Span] = []
        for i, tag in tags.items():
            a, b = int(starts[i]), int(starts[i]) + len(tokens[i].rstrip())
            if tag == 2:
                a = spans.pop()[0]
            spans.append((a, b, "crf"))
        return spans


class _Worker:
    """The decoder of the last field seen: tasks of a worker share what it remembers of tokens."""

    decoder: Decoder | None = None
    field: Field | None = None

    @classmethod
    def of(cls, field: Field | None) -> Decoder | None:
        if cls.field is not field:
            cls.field, cls.decoder = field, None if field is None else Decoder(field)
        return cls.decoder


def all_spans(text: str, decoder: Decoder | None) -> tuple[list[Span], list[Span]]:
    """What the rules find, and that together with what only the field sees."""
    base = rule_spans(text)
    more = decoder.spans(text) if decoder is not None else []
    if base:
        more = [s for s in more if not any(a < s[1] and s[0] < b for a, b, _ in base)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _tagged(text: str, values: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Tokens of a text, and their tags where `values` are its secrets."""
    tokens, at = tokens_of(text)
    tags, k, inside = [], 0, -1
    for token in tokens:
        end = at + len(token.rstrip())
        while k < len(values) and values[k][1] <= at:
            k += 1
        hit = k < len(values) and values[k][0] < end
        tags.append(0 if not hit else 2 if inside == k else 1)
        inside = k if hit else -1
        at += len(token)
    return tokens, tags


def _example(tokens: list[str], tags: list[int], a: int, b: int, whole: list[str], weight: float = 1.0, made: bool = False) -> Example:
    shapes = [_shape(t.rstrip()) for t in tokens[a:b]]
    return Example(shapes, [around(tokens, i) for i in range(a, b)], whole, tags[a:b], weight, made)


def _replaced(value: str) -> list[str]:
    """Other values in a secret's place: letters, digits, a short one, and parts with signs between."""
    seed = zlib.crc32(value.encode())
    n = 4 + seed % 20
    digests = [zlib.crc32(f"{seed}:{i}".encode()) for i in range(n)]
    letters, digits = "".join(chr(97 + d % 26) for d in digests), "".join(str(d % 10) for d in digests)
    cut, sign = 1 + seed % 3, _SIGNS[seed % len(_SIGNS)]
    signed = f"{letters[:cut].title()}{sign}{letters[cut:4]}{_SIGNS[seed // 7 % len(_SIGNS)]}{digits[:3]}{letters[4:8]}"
    return [letters, digits, signed]


def hits(text: str) -> Iterator[Example]:
    """Windows around what the rules find, and the same with other values in its place."""
    if not rule_spans(text):
        return
    values = _values(text)
    whole = _text_features(text)
    reach = 16 * MARGIN
    for a, b in values:
        left, right = text[max(0, a - reach) : a], text[b : b + reach]
        for k, value in enumerate([text[a:b], *_replaced(text[a:b])]):
            near = left + value + right
            # Other secrets in the window keep their tags; the one in the middle has its own.
            own = (len(left), len(left) + len(value))
            others = [v for v in _values(near) if v[1] <= own[0] or own[1] <= v[0]]
            tokens, tags = _tagged(near, sorted([own, *others]))
            at = next(i for i, _ in enumerate(tags) if sum(map(len, tokens[: i + 1])) > own[0] - (len(near) - len(near.lstrip())))
            first = max(0, at - MARGIN)
            yield _example(tokens, tags, first, min(len(tokens), first + PIECE), whole, made=k > 0)


def plain(text: str) -> Iterator[Example]:
    """One window in STRIDE of a text, where nothing is found; its weight is the windows it stands for."""
    tokens, tags = _tagged(text, _values(text))
    windows = -(-len(tokens) // PIECE)
    if not windows:
        return
    whole = _text_features(text)
    shown = -(-windows // STRIDE)
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    for k in range(shown):
        at = (seed + k * windows // shown) % windows * PIECE
        if not any(tags[at : at + PIECE]):
            yield _example(tokens, tags, at, min(len(tokens), at + PIECE), whole, windows / shown)


def _silver(text: str) -> list[Example]:
    """All examples of a text."""
    return [*hits(text), *plain(text)]


def fit(examples: list[Example], rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> Field | None:
    """Maximum likelihood by full-batch AdaGrad; expectations by forward-backward over all windows at once."""
    if not any(any(e.tags) for e in examples):
        return None
    index: dict[str, int] = {}
    rows = []
    for e in examples:
        parts = (e.shapes, e.around, [e.whole] * len(e.tags))
        for view in ((0, 1, 2),) if e.made else ((0, 1, 2), (0, 2), (1, 2)):
            ids = [[index.setdefault(f, len(index)) for k in view for f in parts[k][i]] for i in range(len(e.tags))]
            rows.append((ids, e.tags, e.weight))
    n, longest, most = len(rows), max(len(r[1]) for r in rows), max(len(x) for r in rows for x in r[0])
    pad = len(index)
    ids = np.full((n, longest, most), pad, np.int64)
    gold = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    weight = np.array([r[2] for r in rows])
    for k, (x, tags, _) in enumerate(rows):
        live[k, : len(tags)], gold[k, : len(tags)] = True, tags
        for i, f in enumerate(x):
            ids[k, i, : len(f)] = f
    weights, steps = np.zeros((pad + 1, 3)), np.zeros((3, 3))
    seen_w, seen_s = np.full_like(weights, 1e-8), np.full_like(steps, 1e-8)
    observed = np.eye(3)[gold] * live[..., None]
    both = live[:, :-1] & live[:, 1:]
    share = weight[:, None, None]
    observed_steps = np.einsum("nti,ntj->ij", observed[:, :-1] * share, observed[:, 1:] * both[..., None])
    flat = ids.ravel()
    barred = np.zeros((3, 3))
    barred[0, 2] = -1e9

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        score = weights[ids].sum(axis=2)
        score[:, 0, 2] = -1e9
        moves = steps + barred
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            moved = log_sum(ahead[:, t - 1, :, None] + moves, 1) + score[:, t]
            ahead[:, t] = np.where(live[:, t, None], moved, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = log_sum(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(live[:, t + 1, None], moved, 0.0)
        total = log_sum(ahead[:, -1], 1)
        expected = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
        pairs = ahead[:, :-1, :, None] + moves + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected_steps = (np.exp(np.minimum(pairs, 0.0)) * both[..., None, None] * share[..., None]).sum(axis=(0, 1))
        missed = (observed - expected) * share
        slope_w = np.column_stack([np.bincount(flat, np.repeat(missed[..., k].ravel(), most), pad + 1) for k in range(3)])
        slope_w[pad] = 0.0
        slope_w -= decay * n * weights
        slope_s = observed_steps - expected_steps - decay * n * steps
        seen_w += slope_w**2
        seen_s += slope_s**2
        weights += rate * slope_w / np.sqrt(seen_w)
        steps += rate * slope_s / np.sqrt(seen_s)
    return Field(index, weights, steps)


_EXAMPLE = "shapes array<array<string>>, around array<array<string>>, whole array<string>, tags array<bigint>, weight double, made boolean"


def _examples(texts: DataFrame, of) -> DataFrame:
    """What `of` yields for every text."""
    words = pa.list_(pa.string())
    kinds = [pa.list_(words), pa.list_(words), words, pa.list_(pa.int64()), pa.float64(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.cut(batches, "_text"):
            found = [e for t in blocks.texts(batch.column(0)) for e in of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], kind) for k, kind in enumerate(kinds)], list(Example._fields))

    return texts.mapInArrow(run, _EXAMPLE)


def train(docs: DataFrame, text: str = "text", n_hits: int = TRAIN_HITS, n_plain: int = TRAIN_PLAIN, n_texts: int = TRAIN_TEXTS) -> Field | None:
    """The field fitted on at most n_hits rule hits of all texts and n_plain windows of about n_texts texts."""
    rows = docs.select(F.col(f"`{text}`").alias("_text"))
    total = rows.count()
    # Equal texts fall on the same side of the hash; a distinct keeps copies from outweighing the rest.
    found = staging.written(_examples(rows, hits).distinct(), "secret-hits")
    all_hits = found.where("not made").count()
    if not all_hits:
        return None
    by_hash = F.xxhash64("shapes", "around")
    share = min(1.0, n_texts / total)
    part = F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) < int(1_000_000 * share) if share < 1 else F.lit(True)
    others = staging.written(_examples(rows.where(part).distinct(), plain), "plain-windows")
    # Each kind of example, replaced values too, is picked by hash up to its bound.
    picked = [Example(*r) for r in found.where("not made").orderBy(by_hash).limit(n_hits).collect()]
    picked += [Example(*r) for r in found.where("made").orderBy(by_hash).limit(3 * n_hits).collect()]
    standing = (others.agg(F.sum("weight")).first()[0] or 0.0) / share
    calm = [Example(*r) for r in others.orderBy(by_hash).limit(n_plain).collect()]
    shown = sum(e.weight for e in calm)
    scale = standing / shown * min(1.0, n_hits / all_hits) if shown else 1.0
    return fit(picked + [e._replace(weight=e.weight * scale) for e in calm])


def scan(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """docs' doc_id with base and all spans: arrays of (start, stop, kind), code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
    spans = "array<struct<start:bigint,stop:bigint,kind:string>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Worker.of(shared.value)
        for batch in blocks.cut(batches, "_text"):
            found = [all_spans(t, decoder) for t in blocks.texts(batch.column(0))]
            columns = [pa.array([[dict(zip(("start", "stop", "kind"), s)) for s in x[k]] for x in found], span) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *columns], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(f"`{text}`").alias("_text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id bigint, base {spans}, spans {spans}")


