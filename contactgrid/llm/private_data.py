"""Personal data: exact patterns, and a skip-chain conditional random field that carries their labels to repeated and similar tokens of a document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Labels: none, then the kinds.
LABELS = 1 + len(KINDS)
#: What a label that the patterns didn't give has to have as its marginal.
LEAST_MARGINAL = 0.9
ROUNDS, DAMPING, PENALTY, STEPS = 20, 0.5, 0.001, 600
#: Log potential, before the fit moves it, of two alike tokens having one label: exact patterns can't teach it, as what they miss has the wrong label.
AGREE = 12.0

_GAP = " \t\n\x0b\x0c\r"
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# the patterns' own rules, in forms that take linear time on any text
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TELLING = re.compile(r"[0-9@]|[(\[{](?:at|AT)[)\]}]")
_MASKED = ((re.compile(r"[(\[{](?:at|AT)[)\]}]"), "@"), (re.compile(r"[(\[{](?:dot|DOT)[)\]}]"), "."))
_WHOLE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_SPACE = re.compile(f"[{_GAP}]")
_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "+()@")

#: How many values each attribute of a token has: what it looks like, its digits, a plus in front, letters, parentheses, marks inside.
ATTRIBUTES = (5, 7, 2, 2, 2, 2)
FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, kinds array<int>, starts array<int>, ends array<int>, t_start array<int>, t_end array<int>, "
    "t_shape array<int>, t_label array<int>, t_linked array<int>, t_digits array<int>, hub array<int>, leaf array<int>, told array<int>"
)
SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def passes_luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _address(dotted: str) -> bool:
    parts = [p.lstrip("0") for p in dotted.split(".")]
    return len(parts) == 4 and all(len(p) < 3 or (len(p) == 3 and int(p) <= 255) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the exact patterns find, by kind, then start: leftmost, not overlapping within a kind; matches that fail their rule are dropped."""
    found, last, last_at = [], 0, -1
    for m in _DOMAIN.finditer(text):
        before = text[max(last, text.rfind("@", last, m.start()) + 1) : m.start()]
        start = m.start() - len(before) + len(before.rstrip(_LOCAL))
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _address(m.group())]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group()) if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the marks around it."""
    word = text[start:end]
    front = len(word) - len(word.lstrip(_TRIM))
    word = word.strip(_TRIM)
    if word.startswith("(") and (")" not in word or (word.endswith(")") and "@" in word)):
        front, word = front + 1, word[1:]
    if word.endswith(")") and "(" not in word:
        word = word[:-1].rstrip(_TRIM)
    return start + front, start + front + len(word)


def tokens(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, raw start, raw end) of the words with a digit or an at sign, without the marks around them. All other words have no label."""
    out, at = [], 0
    while m := _TELLING.search(text, at):
        raw = 1 + max(text.rfind(c, at, m.start()) for c in _GAP)
        raw = max(raw, at)
        gap = _SPACE.search(text, m.start())
        at = gap.start() if gap else len(text)
        start, end = _core(text, raw, at)
        if start < end:
            out.append((start, end, raw, at))
    return out


def _looks(word: str) -> tuple[int, str, list[str]]:
    """A token's attributes as one number, its digits, and the keys by which it is alike to others: written out alike, and equal last seven digits."""
    if len(word) > 400:  # no entity is that long
        return 0, "", []
    for pattern, sign in _MASKED:
        word = pattern.sub(sign, word)
    digits = _NO_DIGIT.sub("", word)
    letters = any(c.isalpha() for c in word)
    bare = not letters and not word.strip("0123456789-")
    like = 0
    if "@" in word:
        like = int(_WHOLE_EMAIL.fullmatch(word) is not None)
    elif _IP.fullmatch(word) and _address(word):
        like = 2
    elif bare and 16 <= len(digits) <= 19:
        like = 3 if passes_luhn(digits) else 4
    n = len(digits)
    size = 0 if not n else 1 + sum(n > k for k in (3, 6, 9, 15, 19))
    shape = 0
    for value, many in zip((like, size, word.startswith("+"), letters, "(" in word or ")" in word, bool(re.search(r"[0-9][-.][0-9]", word))), ATTRIBUTES, strict=True):
        shape = shape * many + int(value)
    keys = ["@" + word.lower()] if like == 1 else ["#" + digits, digits[-7:]] if n >= 7 and not letters else []
    return shape, digits, keys


def _graph(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[int]]:
    """The document's tokens as nodes, with the labels of the exact patterns; neighbours and alike tokens as edges; and what each token tells the fit.

    Alike tokens are linked with one of them, the first that has a label, or else the first: so a token that is repeated n times has n - 1 links.
    """
    found = tokens(text)
    label, order = np.zeros(len(found), int), sorted(spans, key=lambda s: s[1])
    starts = [t[0] for t in found]
    for kind, start, end in sorted(order, key=lambda s: -s[0]):  # of two kinds, the one listed first stays
        k = int(np.searchsorted(starts, start, "right")) - 1
        k = max(k, 0)
        while k < len(found) and found[k][0] < end:
            if found[k][1] > start:
                label[k] = kind + 1
            k += 1
    shape, digits, groups = [], [], {}
    for k, (start, end, _, _) in enumerate(found):
        s, d, keys = _looks(text[start:end])
        shape.append(s)
        digits.append(len(d))
        for key in keys:
            groups.setdefault(key, []).append(k)
    links = {}
    for members in groups.values():
        if len(members) > 1:
            hub = next((k for k in members if label[k]), members[0])
            links.update({(hub, k): None for k in members if k != hub and (k, hub) not in links})
    linked = [int(k + 1 < len(found) and not text[found[k][3] : found[k + 1][2]].strip(" ")) for k in range(len(found))]
    alike = np.full(len(found), -1)
    for hub, leaf in links:
        alike[leaf] = label[hub] if alike[leaf] < 0 else alike[leaf]
    told = []
    for k in range(len(found)):
        before = label[k - 1] if k and linked[k - 1] else 0
        after = label[k + 1] if linked[k] else 0
        told.append(int((((shape[k] * LABELS + label[k]) * LABELS + before) * LABELS + after) * (LABELS + 1) + alike[k] + 1))
    return {
        "t_start": starts, "t_end": [t[1] for t in found], "t_shape": shape, "t_label": label.tolist(), "t_linked": linked, "t_digits": digits,
        "hub": [a for a, _ in links], "leaf": [b for _, b in links], "told": told,
    }


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FOUND.split(", ")]
    for batch in batches:
        columns = {n: [] for n in names}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            spans = base_spans(text)
            row = {"doc_id": doc_id, **{f"n_{k}": sum(s[0] == i for s in spans) for i, k in enumerate(KINDS)}, "base_sha256": sha256(_shown(spans).encode()).hexdigest()}
            row |= dict(zip(("kinds", "starts", "ends"), ([s[i] for s in spans] for i in range(3)), strict=True)) | _graph(text, spans)
            for n in names:
                columns[n].append(row[n])
        kind = lambda n: pa.int64() if n == "doc_id" or n.startswith("n_") else pa.string() if n == "base_sha256" else pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(columns[n], kind(n)) for n in names], names)


def _attributes(shape: np.ndarray) -> np.ndarray:
    """Of each shape the rows of the attributes' weights."""
    out, first = [], sum(ATTRIBUTES)
    for many in reversed(ATTRIBUTES):
        first -= many
        out.append(first + shape % many)
        shape = shape // many
    return np.stack(out, axis=1)


class Weights:
    """Log potentials: of labels by a token's attributes, of neighbours (left, right), and of alike tokens (either way)."""

    def __init__(self):
        self.own = np.zeros((sum(ATTRIBUTES), LABELS))
        self.chain = np.zeros((LABELS, LABELS))
        self.skip = AGREE * np.eye(LABELS)

    def fit(self, told: np.ndarray, n: np.ndarray) -> Weights:
        """Maximizes the mean pseudo-likelihood, with a penalty on squared moves from the start, so that tables of all sizes fit alike: each label given its token, its neighbours' labels and that of its alike token.

        ``told``: distinct cases as _graph() packs them, ``n``: how many tokens there are of each. The maximum is unique; it is climbed by a fixed number of steps.
        """
        if not len(told):
            return self
        rest, alike = told // (LABELS + 1), told % (LABELS + 1) - 1
        rest, after = rest // LABELS, rest % LABELS
        rest, before = rest // LABELS, rest % LABELS
        rows, label = _attributes(rest // LABELS), rest % LABELS
        share = (n / n.sum())[:, None]
        has = (alike >= 0)[:, None]
        parts = [self.own, self.chain, self.skip]
        start = [p.copy() for p in parts]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, STEPS + 1):
            score = self.own[rows].sum(1) + self.chain[before] + self.chain[:, after].T + np.where(has, self.skip[alike], 0)
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            miss = -p
            miss[np.arange(len(told)), label] += 1
            miss *= share
            slopes = [np.zeros_like(x) for x in parts]
            for column in rows.T:
                np.add.at(slopes[0], column, miss)
            np.add.at(slopes[1], before, miss)
            np.add.at(slopes[1].T, after, miss)
            np.add.at(slopes[2], alike[has[:, 0]], miss[has[:, 0]])
            slopes[2] = slopes[2] + slopes[2].T  # one potential for both ends
            for k, part in enumerate(parts):
                g = slopes[k] - PENALTY * (part - start[k])
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                part += 0.05 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
        return self


def marginals(own: np.ndarray, edges: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Loopy belief propagation, all messages at once: of each node the probabilities of its labels.

    own: log potentials by node; edges: (a, b) rows; potential: of each edge the log potentials by a's and b's label. A number of rounds
    that doesn't depend on the data, so a document's result doesn't depend on which others are in its batch.
    """
    a, b = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    between = np.concatenate([potential, potential.transpose(0, 2, 1)])
    twin = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    message = np.zeros((len(a), own.shape[1]))

    def belief():
        return own + np.stack([np.bincount(b, message[:, y], len(own)) for y in range(own.shape[1])], axis=1)

    for _ in range(ROUNDS if len(edges) else 0):
        cavity = (belief()[a] - message[twin])[:, :, None] + between
        top = cavity.max(1)
        new = top + np.log(np.exp(cavity - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * new
    last = belief() if len(edges) else own
    p = np.exp(last - last.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _plausible(kind: int, shape: int, digits: int, linked: bool) -> bool:
    """The exact check behind the model: an address looks like one, a card's digits are right, and a phone number has a plus in front or is alike to one."""
    like, plus = shape // (np.prod(ATTRIBUTES) // ATTRIBUTES[0]), shape // np.prod(ATTRIBUTES[3:]) % 2
    return 7 <= digits <= 15 and (plus or linked) if kind == 3 else like == kind + 1


def _labelled(batches: Iterator[pa.RecordBatch], w: Weights) -> Iterator[pa.RecordBatch]:
    whole = np.prod(ATTRIBUTES) // ATTRIBUTES[0]
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        flat = {n: c[n].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in ("t_start", "t_end", "t_shape", "t_label", "t_linked", "t_digits", "hub", "leaf")}
        sizes, links = (pc.list_value_length(c[n]).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("t_start", "hub"))
        first = np.cumsum(sizes) - sizes
        shift = np.repeat(first, links)
        label, linked = flat["t_label"], flat["t_linked"] > 0
        own = w.own[_attributes(flat["t_shape"])].sum(1)
        before = np.r_[False, linked[:-1]] if len(linked) else linked
        own = own + np.where(before[:, None], 0, w.chain[0]) + np.where(linked[:, None], 0, w.chain[:, 0])
        own = np.where((label > 0)[:, None] & (np.arange(LABELS) != label[:, None]), -60.0, own)  # the exact patterns' labels stay
        known = np.zeros(len(label), np.int64)  # the label of the exact patterns that an alike token has
        known[flat["leaf"] + shift] = label[flat["hub"] + shift]
        near = np.flatnonzero(linked)
        edges = np.concatenate([np.stack([near, near + 1], axis=1), np.stack([flat["hub"] + shift, flat["leaf"] + shift], axis=1)])
        potential = np.concatenate([np.repeat(w.chain[None], len(near), 0), np.repeat(w.skip[None], len(shift), 0)])
        p = marginals(own, edges, potential) if len(own) else own
        best = np.where((label == 0) & (p.max(1) >= LEAST_MARGINAL), p.argmax(1), 0) if len(own) else label
        spans = []
        for d in range(len(batch)):
            base = list(zip(c["kinds"][d].as_py(), c["starts"][d].as_py(), c["ends"][d].as_py(), strict=True))
            mine, k, stop = [], int(first[d]), int(first[d] + sizes[d])
            while k < stop:
                if not best[k]:
                    k += 1
                    continue
                run = [k]
                alone = flat["t_shape"][k] // whole in (1, 2, 3)
                while not alone and linked[run[-1]] and best[run[-1] + 1] == best[k] and flat["t_shape"][run[-1] + 1] // whole not in (1, 2, 3):
                    run.append(run[-1] + 1)
                kind, start, end = int(best[k]) - 1, int(flat["t_start"][k]), int(flat["t_end"][run[-1]])
                if _plausible(kind, int(flat["t_shape"][k]), int(flat["t_digits"][run].sum()), bool((known[run] == kind + 1).any())):
                    mine.append((kind, start, end))
                k = run[-1] + 1
            spans.append(_shown(sorted(base + mine)))
        kept = [c[f.name] for f in SPANS if f.name != "spans"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.string())], schema=SPANS)


def find_private_data(docs: DataFrame) -> DataFrame:
    """Of each document doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, as kind:start:end in code points, by kind and start.

    The exact patterns' spans always stay; the four numbers and base_sha256 are theirs alone. The model adds spans: words with a digit or an at sign
    are nodes with one of five labels, others have none for sure. Neighbours share a potential, and so do tokens of a document, however distant, that are
    written alike (masked signs such as ``[at]`` read as what they mean) or end in the same seven digits. Labels that the patterns gave are fixed; sums of products over rounds
    of messages give the others their marginals, and what has one of ``LEAST_MARGINAL`` and looks like its kind is a span.

    The potentials are fitted on all documents: what a token tells the fit is one of a bounded number of cases, which Spark counts. The
    documents are read once; found spans and tokens are stored and read again for both. Each document's graph has its own nodes, and links that are at most twice as many.
    Null or empty text: no spans. Null doc_id: stays null. Repeated rows: each is a row. Other columns are not read. No rows: no rows.
    """
    found = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found, FOUND), "private-tokens")
    told = found.select(F.explode("told").alias("told")).groupBy("told").agg(F.count(F.lit(1)).alias("n")).collect()  # cases are bounded by _graph()'s packing
    told = sorted((r["told"], r["n"]) for r in told)
    w = Weights().fit(np.array([t for t, _ in told], np.int64), np.array([n for _, n in told], float))
    return found.mapInArrow(lambda batches: _labelled(batches, w), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
