"""Operator 13: personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, payment cards and phone numbers.
The field then labels every token with a digit or an at sign (no kind occurs
without one) as one of the four kinds or as none.  Its potentials are hashed
features of the token and its neighbours, label pairs of adjacent tokens, and
label pairs over skip edges: occurrences of the same token, or of tokens that
end in the same digits, anywhere in the document.  An edge joins an occurrence
to the next one, so edges grow with the tokens, not with their pairs.  Loopy
message passing carries the label of a token that a rule has found to its other
occurrences.  Rule spans are observed and stay; runs of tokens that the field
labels with one kind become further spans.

The weights are trained by pseudo-likelihood on what the rules find in at most
``SAMPLE`` documents, chosen by hash.  Tokens that no rule covers may still be
personal data, so as negatives they weigh less; in every epoch the features of
some tokens are hidden, so that neighbours learn to speak for them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import chunks

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)                       # label of tokens that are no personal data
LABELS = NONE + 1
#: Documents that a fit may use, each of at most so many tokens.
SAMPLE, SAMPLE_TOKENS = 4_000, 250
FEATURES, WIDTH = 1 << 14, 10
ROUNDS, DAMPING, EPOCHS, RATE, UNSURE, HIDDEN = 12, 0.5, 150, 0.5, 0.3, 0.3
#: Marginal probability from which a token takes a kind.
LEAST = 0.6
#: Digits that tokens have to share at their end, and that a span of a kind needs.
TAIL, LEAST_DIGITS = 7, {"email": 0, "ip": 4, "card": 12, "phone": 7}

SPACES = " \t\n\x0b\x0c\r"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the look-behinds only skip starts that fail, so long runs take one pass
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+")
#: Code points beside a token that are searched for its neighbours.
NEAR = 40


# --- rules -------------------------------------------------------------------
def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    low = 0                             # no local part reaches before it
    while at >= 0:
        low = max(low, done)
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        low = at + 1
        at = text.find("@", max(low, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then by start; code points."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the graph of a document ---------------------------------------------------
@dataclass
class Graph:
    """Tokens of several documents: features, labels that rules observe (−1:
    open), and edges (earlier token, later token)."""

    doc: list = field(default_factory=list)
    span: list = field(default_factory=list)
    feature: list = field(default_factory=list)
    seen: list = field(default_factory=list)
    chain: list = field(default_factory=list)
    skip: list = field(default_factory=list)
    alone_before: list = field(default_factory=list)    # a plain word or nothing stands there
    alone_after: list = field(default_factory=list)

    def add(self, doc: int, text: str, base: list[tuple[str, int, int]]) -> None:
        cover = sorted((a, b, KINDS.index(k)) for k, a, b in base)
        first, at, last = len(self.span), 0, {}
        for m in TOKEN.finditer(text):
            start, end = m.span()
            i = len(self.span)
            while at < len(cover) and cover[at][1] <= start:
                at += 1
            hit = [c for c in cover[at:at + 4] if c[0] < end and c[1] > start]
            core = m[0].strip(".,;:!?()[]{}<>\"'").lower()
            before, after = text[max(0, start - NEAR):start].split(), text[end:end + NEAR].split()
            joined = i > first and not text[self.span[-1][1]:start].strip(SPACES)
            if joined:
                self.chain.append((i - 1, i))
                self.alone_after[-1] = False
            self.doc.append(doc)
            self.span.append((start, end))
            self.seen.append(hit[0][2] if hit else -1)
            self.alone_before.append(not joined)
            self.alone_after.append(True)
            self.feature.append(_features(core, before[-1].lower() if before else "", after[0].lower() if after else ""))
            digits = _digits(core)
            keys = (core, digits[-TAIL:]) if len(digits) >= TAIL else (core,)
            linked = {last[k] for k in keys if k in last} - ({i - 1} if joined else set())
            self.skip += [(j, i) for j in sorted(linked)]
            last.update(dict.fromkeys(keys, i))


def _shape(word: str) -> str:
    return re.sub(r"a+", "a", "".join(["9" if c.isdigit() else "a" if c.isalpha() else c for c in word[:24]]))


@lru_cache(maxsize=1 << 14)
def _features(core: str, before: str, after: str) -> list[int]:
    digits = len(_digits(core[:64]))
    names = ["bias", "shape " + _shape(core), "run " + re.sub(r"9+", "9", _shape(core)), f"digits {min(digits, 20)}",
             f"size {min(len(core), 30) // 3}", f"at {'@' in core} dot {min(core.count('.'), 4)}", "before " + before[-NEAR:],
             "after " + after[:NEAR], "shape before " + _shape(before), "shape after " + _shape(after)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names]


# --- the field -----------------------------------------------------------------
@dataclass
class Field:
    """Log potentials: of a feature and a label, of labels of adjacent tokens
    (earlier, later), and of labels over a skip edge (symmetric)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def marginals(unary: np.ndarray, edges: np.ndarray, kind: np.ndarray, potentials: np.ndarray,
              rounds: int = ROUNDS) -> np.ndarray:
    """Log marginals per node by loopy sum-product: an edge's potential is the
    labels x labels matrix of its kind, rows for its first node."""
    if not len(edges):
        return _log_softmax(unary)
    n, labels = unary.shape
    a, b = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    both = np.concatenate((potentials, potentials.transpose(0, 2, 1)))      # from a to b
    way = np.concatenate((kind, kind + len(potentials)))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    message = np.zeros((len(a), labels))

    def beliefs():
        return unary + np.stack([np.bincount(b, message[:, k], n) for k in range(labels)], axis=1)

    for _ in range(rounds):
        cavity = beliefs()[a] - message[back]
        new = np.empty_like(message)
        for k in range(labels):
            x = cavity + both[:, :, k][way]
            top = x.max(axis=1)
            new[:, k] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        message = DAMPING * message + (1 - DAMPING) * _log_softmax(new)
    return _log_softmax(beliefs())


def _pairs(edges: list) -> np.ndarray:
    return np.array(edges, np.int64).reshape(-1, 2)


def label(graph: Graph, model: Field) -> np.ndarray:
    """Log marginals of every token; observed labels are fixed."""
    features = np.array(graph.feature, np.int64).reshape(-1, WIDTH)
    unary = np.zeros((len(features), LABELS))
    for k in range(WIDTH):
        unary += model.unary[features[:, k]]
    # a neighbour without digit or at sign is known to be no personal data
    unary += np.array(graph.alone_before)[:, None] * model.chain[NONE] + np.array(graph.alone_after)[:, None] * model.chain[:, NONE]
    seen = np.array(graph.seen, np.int64)
    known = np.flatnonzero(seen >= 0)
    fixed = np.full((len(known), LABELS), -60.0)
    fixed[np.arange(len(known)), seen[known]] = 0.0
    unary[known] = fixed
    chain, skip = _pairs(graph.chain), _pairs(graph.skip)
    kind = np.repeat([0, 1], [len(chain), len(skip)])
    return marginals(unary, np.concatenate((chain, skip)), kind, np.stack((model.chain, model.skip)))


def train(feature: np.ndarray, target: np.ndarray, sure: np.ndarray, before: np.ndarray, after: np.ndarray,
          skip: np.ndarray, epochs: int = EPOCHS) -> Field:
    """Pseudo-likelihood by AdaGrad: ``before`` / ``after`` are the neighbours'
    labels, ``skip`` the pairs of tokens that skip edges join."""
    unary, chain, links = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    if not len(target):
        unary[:, NONE] = 1.0
        return Field(unary, chain, links)
    past = [np.full_like(w, 1e-6) for w in (unary, chain, links)]
    ends = np.concatenate((skip, skip[:, ::-1]))
    n, lane, rng = len(target), np.arange(LABELS), np.random.default_rng(1)
    for _ in range(epochs):
        shown = (rng.random(n) >= HIDDEN)[:, None]
        score = unary[feature].sum(axis=1) * shown + chain[before] + chain[:, after].T
        np.add.at(score, ends[:, 0], links[target[ends[:, 1]]])
        error = np.exp(_log_softmax(score))
        error[np.arange(n), target] -= 1.0
        error *= sure[:, None] / n
        steps = [np.stack([np.bincount(feature.ravel(), np.repeat((error * shown)[:, k], WIDTH), FEATURES)
                           for k in lane], axis=1),
                 np.zeros_like(chain), np.zeros_like(links)]
        np.add.at(steps[1], before, error)
        np.add.at(steps[1].T, after, error)
        np.add.at(steps[2], target[ends[:, 1]], error[ends[:, 0]])
        steps[2] = (steps[2] + steps[2].T) / 2
        for w, g, h in zip((unary, chain, links), steps, past):
            g = g + 1e-6 * w
            h += g * g
            w -= RATE * g / np.sqrt(h)
    return Field(unary, chain, links)


_ROWS = "doc int, feature binary, target binary, before binary, after binary, skip binary"


def fit(df: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on the rule spans of at most ``sample`` distinct documents
    (the least hashes of id and text) of up to ``SAMPLE_TOKENS`` tokens each; only
    numbers of these tokens reach the driver.  Without any token: a field that
    labels nothing."""
    rows = df.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"),
                     F.col("text").cast("string").alias("text")).filter("text is not null")
    n = rows.count()
    share = min(1.0, 1.5 * sample / max(n, 1))
    bound = int(-2 ** 63 + share * (2 ** 64 - 1))
    near = rows.filter(F.col("h") <= F.lit(max(min(bound, 2 ** 63 - 1), -2 ** 63)).cast("long")) if share < 1 else rows
    chosen = near.filter(F.length("text") > 0).dropDuplicates(["h"]).orderBy("h").limit(sample)

    def numbers(batches):
        for c in chunks(batches):
            out = {k: [] for k in ("doc", "feature", "target", "before", "after", "skip")}
            for text in c.column("text").to_pylist():
                g = Graph()
                g.add(0, text, base_spans(text))
                if not 0 < len(g.span) <= SAMPLE_TOKENS:
                    continue
                target = np.array([s if s >= 0 else NONE for s in g.seen], np.int64)
                before, after = np.full(len(target), NONE), np.full(len(target), NONE)
                for a, b in g.chain:
                    before[b], after[a] = target[a], target[b]
                for k, v in (("feature", np.array(g.feature, np.int64)), ("target", target), ("before", before),
                             ("after", after), ("skip", _pairs(g.skip))):
                    out[k].append(v.astype(np.int64).tobytes())
                out["doc"].append(len(target))
            if out["doc"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                    [("doc", pa.int32()), *((k, pa.binary()) for k in ("feature", "target", "before", "after", "skip"))]))

    got = chosen.mapInArrow(numbers, _ROWS).toArrow()
    # in the order of the content, so that the fit does not follow the partitions
    keep = sorted(got.to_pylist(), key=lambda r: (r["feature"], r["target"], r["skip"]))
    join = lambda k: np.frombuffer(b"".join(r[k] for r in keep), np.int64)
    first = np.concatenate(([0], np.cumsum([r["doc"] for r in keep]))).astype(np.int64)
    skip = [np.frombuffer(r["skip"], np.int64).reshape(-1, 2) + at for r, at in zip(keep, first[:-1])]
    target = join("target")
    return train(join("feature").reshape(-1, WIDTH), target, np.where(target == NONE, UNSURE, 1.0),
                 join("before"), join("after"), np.concatenate([np.empty((0, 2), np.int64), *skip]))


def _more_spans(text: str, graph: Graph, at: range, kind: np.ndarray, base: list) -> list[tuple[str, int, int]]:
    """Spans of the runs of adjacent open tokens of one kind, trimmed to letters
    and digits, that touch no rule span and hold enough digits."""
    runs: list[list] = []
    for i in at:
        k = int(kind[i])
        if graph.seen[i] >= 0 or k == NONE:
            continue
        if runs and runs[-1][0] == k and runs[-1][2] == i - 1 and not graph.alone_before[i]:
            runs[-1][2] = i
        else:
            runs.append([k, i, i])
    out = []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    for k, i, j in runs:
        a, b = graph.span[i][0], graph.span[j][1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        name = KINDS[k]
        enough = len(_digits(text[a:b])) >= LEAST_DIGITS[name] and (name != "email" or "@" in text[a + 1:b - 1])
        near = np.searchsorted(starts, b)
        # rule spans of different kinds may overlap; the last two that start before b can reach a
        if enough and a < b and all(e <= a for _, e in taken[max(0, near - 4):near]):
            out.append((name, a, b))
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(df: DataFrame, model: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of
    ``df``: counts and digest of what the rules find, and all spans, those of the
    field included, as ``kind:start:end``.

    Null text counts as empty; an empty text has no span.  Repeated rows give
    equal rows, an empty table gives none; other columns are ignored.  A row is
    judged whole: tokens of one document may be joined however far apart.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)       # FEATURES x LABELS numbers
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        field_ = shared.value
        for c in chunks(batches):
            texts = [t or "" for t in c.column("text").to_pylist()]
            base, graph, place = [], Graph(), []
            for i, text in enumerate(texts):
                base.append(base_spans(text))
                start = len(graph.span)
                graph.add(i, text, base[-1])
                place.append(range(start, len(graph.span)))
            if graph.span:
                p = np.exp(label(graph, field_))
                kind = np.where(p[:, :NONE].max(axis=1) >= LEAST, p[:, :NONE].argmax(axis=1), NONE)
            else:
                kind = np.empty(0, np.int64)
            every = [b + _more_spans(t, graph, at, kind, b) if len(at) else b for t, at, b in zip(texts, place, base)]
            yield pa.RecordBatch.from_arrays(
                [c.column("doc_id"), *(pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([_written(s) for s in every], pa.string())], names=names)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
