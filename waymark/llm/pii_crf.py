"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from patterns, and the field holds them fixed. Its nodes are the words of a document that hold a digit or
``@``; all other words have no label and enter through the features and potentials of their neighbours. A node's features
are its shape, length, affixes and check digit, the words around it, and the name that introduces it, if any. Neighbouring
nodes share a chain potential; words that are equal, or have equal digits, share a skip potential with one of them, the
first, wherever they stand: what is labelled once is found again, two steps away at most. Loopy messages pass over all
edges of a run of documents at once; a label counts where its belief is high. Secrets are a label like the others.

Weights of features, chain and skip potentials are fitted together by gradient, on nodes drawn by a checksum, up to
TRAIN_NODES for each label, each standing for as many as weren't drawn. Their labels are those of the patterns and, for
secrets, of names and values; what a node may know is hidden at random: its neighbours' labels, its twins', its words
around. A value of which the name is hidden and whose twins are too is no secret. So the field learns what a name, a
shape, a neighbour and a twin each say, and finds spans where the patterns see nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import map_rows, plain_documents, read_table

#: Kinds of the base, then the field's own.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS, "secret")
SECRET = LABELS.index("secret")
#: Equal digits join two words if there are so many.
SIMILAR_DIGITS = 6
ROUNDS, DAMPING = 12, 0.3
#: A span needs a word whose label is more likely than this; the other parts of a number are to be likelier than the second.
CERTAIN, PART = 0.8, 0.3
#: The classifier's bound: nodes of each label that the weights are fitted on.
TRAIN_NODES = 6000
#: Of what a node may know, this share is hidden; steps of the gradient, their size, and the weights' penalty.
HIDDEN, STEPS, RATE, PENALTY = 0.4, 120, 0.5, 1e-4
#: Before anything is learned, words like each other favour one label by this much.
LIKENESS = 3.0
#: A feature needs so many of the nodes.
LEAST_SEEN = 2
#: Words of a secret have so many characters, as the values that names introduce.
LEAST_SECRET = 16
#: Documents of about so many words pass their messages together; edges are worked on so many at a time.
RUN_WORDS, RUN_EDGES = 50_000, 50_000
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_secret bigint, n_spans bigint"
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _NOT_DIGIT = re.compile(r"[0-9]"), re.compile(r"[^0-9]+")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_EDGES = ".,;:!?()[]{}<>\"'#$%&*|"
#: A phone number may begin with a bracket.
_LEFT = _EDGES.replace("(", "")
#: A name, a sign and a value, as fixed values.
_SECRET = re.compile(r"""\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|key)["']?\s{0,3}[:=]\s{0,3}["']?((?=[A-Za-z_+/=-]{0,64}[0-9])(?=[0-9_+/=-]{0,64}[A-Za-z])[A-Za-z0-9_+/=-]{16,512})""", re.IGNORECASE)
_CUES = ("token", "secret", "passw", "pwd", "key", "auth", "bearer")
#: The value within a word: its longest run of such characters.
_VALUE = re.compile(r"[A-Za-z0-9_+/-]+={0,2}")
_WORD = re.compile(r"\S+")
#: Characters that are looked through for the words around a node.
_AROUND = 80


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: the part before it, then the domain. Linear in the text."""
    last, before = 0, -1
    at = text.find("@")
    while at >= 0:
        floor = max(last, before + 1)
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        before = at
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the values that a name introduces, which the field learns from; a value has a digit and a letter."""
    low = text.lower() if ":" in text or "=" in text else ""
    if not any(c in low for c in _CUES):
        return []
    return [(SECRET - 1, m.start(1), m.end(1)) for m in _SECRET.finditer(text)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k + 1]}:{a}:{b}" for k, a, b in spans)


def marked_words(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words, by white space, that hold a digit or ``@``."""
    out, end = [], 0
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        out.append((start, end))
        m = _MARK.search(text, end)
    return out


def shape_of(word: str) -> str:
    """Digits as 0, letters as a, other characters as they are; the length of each digit run up to 4, of others 1."""
    classes = re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]", "a", word))
    return re.sub(r"([^0])\1+", r"\1", re.sub(r"0{4,}", "0000", classes))


def features_of(text: str, start: int, end: int, around: bool = True) -> list[str]:
    """The features of a word; without `around` only those of the word itself."""
    whole = text[start:end]
    word = whole.lstrip(_LEFT).rstrip(_LEFT.replace(")", ""))
    digits = len(_DIGIT.findall(word))
    value = max(_VALUE.findall(word), key=len, default="")
    out = ["bias", f"s:{shape_of(word)}", f"n:{len(word).bit_length()}", f"d:{min(digits, 20)}", f"b:{shape_of(word[:2])}", f"e:{shape_of(word[-2:])}", f"p:{word.count('.')},{word.count('@')},{word.count('-')}"]
    bare = word.replace("-", "")
    if bare.isascii() and bare.isdigit() and 13 <= len(bare) <= 19:
        out.append(f"luhn:{luhn(bare)}")
    long = len(value) >= LEAST_SECRET and any(c.isalpha() for c in value) and any(c.isdigit() for c in value)
    if long:
        out.append("value")
    if not around:
        return out
    before = text[max(0, start - _AROUND) : start]
    near = [x.strip(_EDGES + "=").lower() for x in before.split()[-3:]]
    after = _WORD.search(text, end, min(len(text), end + _AROUND))
    sign = text[:start].rstrip(" \"'")[-1:] if start and len(before.strip()) else ""
    names = [x for x in [*near, re.split("[:=]", whole)[0].strip(_EDGES).lower() if re.search("[:=]", whole) else ""] if x]
    named = any(c in x for x in names for c in _CUES) and (sign in "=:" and sign or re.search("[:=]", whole))
    out += [f"w1:{shape_of(near[-1]) if near and _DIGIT.search(near[-1]) else near[-1] if near else ''}", f"w2:{near[-2] if len(near) > 1 else ''}", f"a1:{shape_of(after[0].strip(_EDGES)) if after else ''}", f"sign:{sign if sign in '=:' else ''}"]
    if named:
        out += ["named", f"named:{long}"]
    return out


class Field:
    """The graph of one document: its marked words, the labels that are held (0 where none), and the edges."""

    def __init__(self, text: str, held: list[tuple[int, int, int]]):
        self.words = np.array(marked_words(text), dtype=np.int64).reshape(-1, 2)
        starts, ends = self.words[:, 0], self.words[:, 1]
        n = len(self.words)
        self.labels = np.zeros(n, dtype=np.int64)
        for k, a, b in sorted(held, key=lambda x: -x[1]):  # of several the first in the text counts
            self.labels[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = k + 1
        at = np.flatnonzero(starts[1:] - ends[:-1] == 1)
        self.chain = np.stack([at, at + 1], axis=1)
        keys = np.zeros((n, 2), dtype=np.int64)  # of the word, and of its digits; 0 for none
        for i, (a, b) in enumerate(self.words.tolist()):
            word = text[a:b].strip(_EDGES).lower()
            if len(word) > 3:
                keys[i, 0] = hash(word)
            if len(digits := _NOT_DIGIT.sub("", word)) >= SIMILAR_DIGITS:
                keys[i, 1] = hash("#" + digits)
        self.skip = self._similar(keys)
        self.unary = np.zeros((n, len(LABELS)))

    def _similar(self, keys: np.ndarray) -> np.ndarray:
        """Edges between each word and the hub of its key: the first that's labelled, or else the first."""
        edges = [np.empty((0, 2), dtype=np.int64)]
        for own in keys.T:
            rows = np.flatnonzero(own)
            rows = rows[np.lexsort((self.labels[rows] == 0, own[rows]))]  # by key, labelled ones first, in the text's order
            first = np.flatnonzero(np.r_[True, own[rows][1:] != own[rows][:-1]]) if len(rows) else rows
            size = np.diff(np.r_[first, len(rows)])
            hub = np.repeat(rows[first], size)
            edges.append(np.stack([hub, rows], axis=1)[hub != rows])
        return np.unique(np.concatenate(edges), axis=0)


class Potentials:
    """names: the features' rows in weights (by label); chain: by the labels of a word and the next; skip: of two words like each other."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.names, self.weights, self.chain, self.skip = names, weights, chain, skip

    def score(self, text: str, field: Field) -> None:
        """Sets the field's unary potentials."""
        get = self.names.get
        for i, (a, b) in enumerate(field.words.tolist()):
            rows = [r for r in map(get, features_of(text, a, b)) if r is not None]
            field.unary[i] = self.weights[rows].sum(axis=0)


def infer(fields: list[Field], potentials: Potentials) -> np.ndarray:
    """Beliefs of all words of the fields, in order, by loopy messages over one graph of them all."""
    sizes = [len(f.words) for f in fields]
    offsets = np.r_[0, np.cumsum(sizes)]
    n, k = int(offsets[-1]), len(LABELS)
    unary = np.concatenate([np.asarray(f.unary, dtype=np.float64).reshape(-1, k) for f in fields] or [np.empty((0, k))])
    fixed = np.concatenate([np.asarray(f.labels, dtype=np.int64) for f in fields]) if fields else np.empty(0, dtype=np.int64)
    unary[fixed > 0] = -30.0
    unary[fixed > 0, fixed[fixed > 0]] = 0.0
    moved = lambda edges: np.concatenate([np.asarray(e, dtype=np.int64).reshape(-1, 2) + o for e, o in zip(edges, offsets, strict=False)] or [np.empty((0, 2), dtype=np.int64)])
    chain, skip = moved([f.chain for f in fields]), moved([f.skip for f in fields])
    no_left, no_right = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    no_right[chain[:, 0]] = False
    no_left[chain[:, 1]] = False
    unary[no_left] += potentials.chain[0]  # the word before has no label
    unary[no_right] += potentials.chain[:, 0]
    source = np.concatenate([chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]])
    target = np.concatenate([chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]])
    edges = len(chain) + len(skip)
    cuts = np.cumsum([0, len(chain), len(skip), len(chain), len(skip)]).tolist()
    runs = [(lo, min(lo + RUN_EDGES, b), t) for a, b, t in zip(cuts, cuts[1:], (potentials.chain, potentials.skip, potentials.chain.T, potentials.skip.T), strict=False) for lo in range(a, b, RUN_EDGES)]
    messages = np.zeros((2 * edges, k), dtype=np.float32)

    def beliefs() -> np.ndarray:
        total = unary.copy()
        for j in range(k):
            total[:, j] += np.bincount(target, weights=messages[:, j], minlength=n)
        return total

    for _ in range(ROUNDS if edges else 0):
        now, old, change = beliefs(), messages.copy(), 0.0
        for lo, hi, table in runs:
            back = old[lo + edges : hi + edges] if lo < edges else old[lo - edges : hi - edges]
            new = (now[source[lo:hi]] - back)[:, :, None] + table
            top = new.max(axis=1, keepdims=True)
            new = top[:, 0] + np.log(np.exp(new - top).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            new = DAMPING * old[lo:hi] + (1 - DAMPING) * new
            change = max(change, float(np.abs(new - old[lo:hi]).max()))
            messages[lo:hi] = new
        if change < 1e-4:
            break
    total = beliefs()
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, field: Field, beliefs: np.ndarray, held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The words with a likely label that overlap no held span, without punctuation at their edges.

    Neighbours of one label are one span if they are the parts of a number; a secret is the value within its word.
    """
    best = beliefs.max(axis=1, initial=0.0)
    numbers = (KINDS.index("card") + 1, KINDS.index("phone") + 1)
    labels = beliefs.argmax(axis=1) if len(beliefs) else np.empty(0, dtype=np.int64)
    labels[(best <= np.where(np.isin(labels, numbers), PART, CERTAIN)) | (field.labels > 0)] = 0
    digits = np.array([len(_DIGIT.findall(text[a:b])) for a, b in field.words.tolist()], dtype=np.int64)
    follows = np.zeros(len(labels), dtype=bool)  # goes on from the word before
    left, right = field.chain[:, 0], field.chain[:, 1]
    follows[right] = (labels[left] == labels[right]) & np.isin(labels[left], numbers) & (digits[left] < 13) & (digits[right] < 13)
    taken, at, out = sorted((a, b) for _, a, b in held), 0, []
    for i in np.flatnonzero((labels > 0) & ~follows).tolist():
        j = i
        while j + 1 < len(labels) and follows[j + 1]:
            j += 1
        if best[i : j + 1].max() <= CERTAIN:
            continue
        label, a, b = int(labels[i]), int(field.words[i, 0]), int(field.words[j, 1])
        if label == SECRET:
            value = max(_VALUE.finditer(text, a, b), key=lambda m: m.end() - m.start(), default=None)
            if value is None:
                continue
            a, b = value.span()
        a += len(text[a:b]) - len(text[a:b].lstrip(_LEFT))
        b -= len(text[a:b]) - len(text[a:b].rstrip(_EDGES))
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if b > a and not (at < len(taken) and taken[at][0] < b):
            out.append((label - 1, a, b))
    return out


def labelled_spans(text: str) -> list[tuple[int, int, int]]:
    """What the field learns from: the base spans, and the values that names introduce, where they overlap none of them."""
    base = base_spans(text)
    return base + [s for s in secret_spans(text) if not any(a < s[2] and s[1] < b for _, a, b in base)]


def _state(labels: np.ndarray, edges: np.ndarray, here: int, there: int, none: int) -> np.ndarray:
    """For each word the label of the word at the other end of its edge (the last one's), `none` without one."""
    out = np.full(len(labels), none, dtype=np.int64)
    out[edges[:, here]] = labels[edges[:, there]]
    return out


def training_nodes(docs: DataFrame, rates: list[float] | None) -> DataFrame:
    """Without rates: (label, n), how many words have each label, by task. With: the words that a checksum draws, at each
    label's rate, with what is to be known of them: features, the labels to the left and right, and of the word like it (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(len(LABELS), dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                if not text or not _MARK.search(text):
                    continue
                f = Field(text, labelled_spans(text))
                counts += np.bincount(f.labels, minlength=len(LABELS))
                if rates is None:
                    continue
                seed = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
                drawn = np.random.default_rng(seed).random((len(f.labels), 4))
                left, right = _state(f.labels, f.chain, 1, 0, 0), _state(f.labels, f.chain, 0, 1, 0)
                twin = np.maximum(_state(f.labels, f.skip, 0, 1, -1), _state(f.labels, f.skip, 1, 0, -1))
                open_ones = (f.labels == 0) & (twin > 0)  # like a labelled word, but not labelled: not known to be none, nor are its neighbours
                open_ones |= (f.labels == 0) & ((_state(open_ones, f.chain, 1, 0, 0) > 0) | (_state(open_ones, f.chain, 0, 1, 0) > 0))
                for i in np.flatnonzero((drawn[:, 0] < np.array(rates)[f.labels]) & ~open_ones).tolist():
                    label, known, around = int(f.labels[i]), drawn[i, 1] >= HIDDEN, drawn[i, 2] >= HIDDEN
                    like = int(twin[i]) if drawn[i, 3] >= HIDDEN else -1
                    if label == SECRET and not around and like != SECRET:
                        label = 0  # nothing says so
                    a, b = f.words[i].tolist()
                    weight = 1 / rates[int(f.labels[i])]
                    rows.append((float(drawn[i, 0]), label, weight, features_of(text, a, b, around), int(left[i]) if known else -1, int(right[i]) if known else -1, like))
                    if f.labels[i]:  # and as a repeat of itself, of which only that is known
                        rows.append((float(drawn[i, 0]), int(f.labels[i]), weight, features_of(text, a, b, False), -1, -1, int(f.labels[i])))
            if rows:
                kinds = (pa.float64(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["drawn", "label", "weight", "features", "before", "after", "alike"])
        if rates is None:
            yield pa.record_batch([pa.array(range(len(LABELS)), pa.int32()), pa.array(counts)], ["label", "n"])

    schema = "label int, n bigint" if rates is None else "drawn double, label int, weight double, features array<string>, before int, after int, alike int"
    return map_rows(docs.select("text"), run, schema)


def fit(rows: list) -> Potentials:
    """Weights by gradient from drawn nodes (label, weight, features, before, after, alike): each label given what is known, all at once."""
    k = len(LABELS)
    seen: dict[str, int] = {}
    for r in rows:
        for x in r.features:
            seen[x] = seen.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= LEAST_SEEN))}
    none = len(names)  # a row of zeros
    width = max((len(r.features) for r in rows), default=1)
    ids = np.full((len(rows), width), none, dtype=np.int64)
    for i, r in enumerate(rows):
        own = [names[x] for x in r.features if x in names]
        ids[i, : len(own)] = own
    y, left, right, alike = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("label", "before", "after", "alike"))
    share = np.array([r["weight"] for r in rows])
    share = np.sqrt(share / max(share.sum(), 1e-9))  # rare labels count for more than their share
    share /= max(share.sum(), 1e-9)
    weights, chain, skip = np.zeros((none + 1, k)), np.zeros((k, k)), LIKENESS * np.eye(k)
    past = [np.full(w.shape, 1e-8) for w in (weights, chain, skip)]
    hit = np.eye(k)[y] if len(rows) else np.zeros((0, k))
    for _ in range(STEPS if len(rows) else 0):
        score = weights[ids].sum(axis=1)
        score += np.where(left[:, None] >= 0, chain[left], 0) + np.where(right[:, None] >= 0, chain.T[right], 0) + np.where(alike[:, None] >= 0, skip[alike], 0)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - hit) * share[:, None]
        down = [np.stack([np.bincount(ids.ravel(), np.repeat(off[:, j], width), none + 1) for j in range(k)], axis=1), np.zeros((k, k)), np.zeros((k, k))]
        np.add.at(down[1], left[left >= 0], off[left >= 0])
        np.add.at(down[1].T, right[right >= 0], off[right >= 0])
        np.add.at(down[2], alike[alike >= 0], off[alike >= 0])
        down[2] = (down[2] + down[2].T) / 2
        for w, g, h, start in zip((weights, chain, skip), down, past, (0.0, 0.0, LIKENESS * np.eye(k)), strict=True):
            g += PENALTY * (w - start) / max(1, len(w))
            h += g * g
            w -= RATE * g / np.sqrt(h)
        weights[none] = 0.0
    return Potentials(names, weights, chain, skip)


def train(docs: DataFrame) -> Potentials:
    """Potentials from drawn words of all rows: the driver gets TRAIN_NODES of each label, or a few more, as the draw is by chance."""
    counts = dict(training_nodes(docs, None).groupBy("label").agg(F.sum("n")).collect())  # a row for each label
    rates = [min(1.0, TRAIN_NODES / max(1, counts.get(x) or 0)) for x in range(len(LABELS))]
    return fit(training_nodes(docs, rates).orderBy("drawn", "label", "features", "before", "after", "alike").limit(2 * len(LABELS) * TRAIN_NODES).collect())


def _found(batches: Iterator[pa.RecordBatch], potentials: Potentials, hold: bool = True):
    """For each batch: it, its texts, and each text's base spans and all spans. hold: base spans are held and stay."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) if _MARK.search(t) else [] for t in texts]
        spans = [list(b) if hold else [] for b in base]
        run: list[tuple[int, Field]] = []

        def add(run=run, texts=texts, spans=spans) -> None:
            beliefs, at = infer([f for _, f in run], potentials), 0
            for k, field in run:
                n = len(field.words)
                spans[k] = sorted(spans[k] + added_spans(texts[k], field, beliefs[at : at + n], spans[k]))
                at += n
            run.clear()

        size = 0
        for k, text in enumerate(texts):
            if _MARK.search(text):
                field = Field(text, spans[k])
                if (field.labels == 0).any():  # else there's nothing to find
                    potentials.score(text, field)
                    run.append((k, field))
                    size += len(field.words)
                if size > RUN_WORDS:
                    add()
                    size = 0
        if run:
            add()
        yield batch, texts, base, spans


def find_pii(docs: DataFrame, hold: bool = True) -> DataFrame:
    """One row for each row of docs: how many base spans of each kind, their digest, all spans, how many of them are secrets, and how many there are.

    A null text counts as empty and has no spans. Repeated rows and null doc_ids each give a row; an empty table gives
    none. Offsets are code points, ends exclusive. Of spans that begin alike all are there. A very long text is one field;
    its memory is about 250 bytes for each of its words that hold a digit or ``@``. Only doc_id and text are read. Without
    hold, spans are those of the field alone.
    """
    rows = plain_documents(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(rows))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, _, base, spans in _found(batches, shared.value, hold):
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(joined(own).encode()).hexdigest() for own in base]
            secrets = [sum(s[0] == SECRET - 1 for s in own) for own in spans]
            columns = [*counts, pa.array(digests, pa.string()), pa.array(map(joined, spans), pa.string()), pa.array(secrets, pa.int64()), pa.array(map(len, spans), pa.int64())]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_spans"])

    return map_rows(rows, run, SCHEMA)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{LABELS[kind + 1].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with their spans masked in text; n_chars, where docs has it, is the new length.

    A null text stays null and an empty one empty; every row stays, repeated ones too. Of spans that overlap, the first
    gives the mask. All other columns stay as they are, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(plain_documents(docs, "text")))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts, _, spans in _found(batches, shared.value):
            new = [None if old is None else masked(t, s) for old, t, s in zip(batch.column("text").to_pylist(), texts, spans, strict=True)]
            names = batch.schema.names
            columns = dict(zip(names, batch.columns, strict=True)) | {"text": pa.array(new, batch.schema.field("text").type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], batch.schema.field("n_chars").type)
            yield pa.record_batch([columns[c] for c in names], names)

    return map_rows(docs, run, docs.schema)


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii_crf": op4_pii_crf}
ORACLE_SQL: dict[str, str] = {}
