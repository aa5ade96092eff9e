"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans.  In every document, each token with a digit or an
at sign, and each token that is the user part of an address and no role name
(``ROLE_NAMES``), becomes a node of a field over the labels ``LABELS``; all other tokens are nothing.  Neighbouring
nodes share a transition potential; nodes that repeat each other anywhere in
the document (same address or user part, same last seven digits) share a hub
node, joined to each by a skip potential that favours one label.  A hub takes
the label that the patterns give to its tokens, so evidence reaches all repeats
alike, however many there are.  Loopy sum-product messages then settle the
labels, so a number that is written
plainly once and in another form elsewhere is found in both places.  Tokens
that the patterns cover are evidence.  Runs of one label outside the base
spans are added; base spans stay.

Weights are fitted on a bounded sample: candidate tokens of at most
``SAMPLE_DOCS`` documents with a digit or an at sign (those of the smallest
hash), at most ``SAMPLE_TOKENS`` tokens (those of the smallest hash of document
and position), labelled by the patterns.  Everything else runs on
all documents and whole texts.  A key has one hub, so a round of messages costs
the document's number of tokens; rounds go on until messages stand still.

Null and empty texts have no spans, and an empty table gives an empty one;
repeated rows repeat; only the id and text columns are read, so others cannot
clash.  Tokens and spans are found in one walk over a text of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_DOCS = 400
SAMPLE_TOKENS = 20_000
SKIP_WEIGHT = 4.0
EVIDENCE = 8.0
#: Messages stand still long before; stops a loop that swings for ever.
ROUNDS = 1000
LEAST_BELIEF = 0.6
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 7}

# User parts that name a role, not a person; as bare words they are ordinary text.
ROLE_NAMES = frozenset(
    "abuse account accounts admin administrator advertising alerts billing booking bookings business careers "
    "community contact customer customers customerservice design developer developers director editor editorial "
    "education events experts feedback finance founder general guest hello helpdesk hosting hotel information "
    "inquiries investor invoice legal letters library loans mailbox mailer manager marketing media members "
    "membership newsletter noreply notifications office online orders owner partner partners partnership payment "
    "payments postmaster press privacy product products projects questions recruiting reception registration "
    "research reservations returns reviews sales school schools science secretary security service services "
    "shipping status store student studio submissions subscribe support teacher tickets training travel "
    "unsubscribe update updates volunteer webmaster welcome".split()
)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# After the first digit of a run no later start of that run can match, and
# possessive repeats cannot give back anything that helps.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Tokens are these runs without the dots at their end.
RUN = re.compile(r"[^\s,;:!?\"'()<>\[\]{}|]+")
BETWEEN = re.compile(r"[\s()]*")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        match = DOMAIN.match(text, at + 1)
        if match:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = match.end()
                yield "email", start, done
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then kind; linear in the length of the text."""
    found = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


# --- tokens and features ------------------------------------------------------------------------------

FEATURES = (
    "always", "at", "address", "quad", "plus", "letters", "hyphen", "dots", "luhn", "after_plus", "after_node",
    "before_node", "d1", "d3", "d5", "d9", "d12", "d16", "d20",
)
_FLOORS = ((20, "d20"), (16, "d16"), (12, "d12"), (9, "d9"), (5, "d5"), (3, "d3"), (1, "d1"))
_PLACE = {f: i for i, f in enumerate(FEATURES)}


class Nodes(NamedTuple):
    """Candidate tokens of a text: places, features, whether joined to the one before."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    joined: np.ndarray
    keys: list[list[str]]


def nodes_of(text: str) -> Nodes:
    runs = RUN.finditer(text) if "@" in text or DIGIT.search(text) else ()
    bare = ((m.start(), m[0].rstrip(".")) for m in runs)
    tokens = [((s, s + len(t)), t) for s, t in bare if t]
    users = {t.lower().split("@")[0] for _, t in tokens if "@" in t}
    users = {u for u in users if len(u) >= 5 and u not in ROLE_NAMES}
    spans = [s for s, t in tokens if "@" in t or DIGIT.search(t) or (users and t.lower() in users)]
    n = len(spans)
    features = np.zeros((n, len(FEATURES)))
    joined = np.zeros(n, bool)
    keys: list[list[str]] = []
    for i, (s, e) in enumerate(spans):
        token = text[s:e]
        digits = "".join(DIGIT.findall(token))
        joined[i] = i > 0 and BETWEEN.fullmatch(text, spans[i - 1][1], s) is not None
        on = ["always"]
        on += ["at"] * ("@" in token) + ["address"] * bool(re.fullmatch(r"[^@]+@[^@]+\.[^@.]+", token))
        on += ["quad"] * bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", token)) + ["plus"] * (token[0] == "+")
        on += ["letters"] * any(c.isalpha() for c in token) + ["hyphen"] * ("-" in token) + ["dots"] * ("." in token)
        on += ["luhn"] * (12 <= len(digits) <= 19 and luhn(digits))
        on += ["after_node"] * bool(joined[i]) + ["after_plus"] * bool(joined[i] and text[spans[i - 1][0]] == "+")
        on += [next((name for floor, name in _FLOORS if len(digits) >= floor), "always")]
        for name in on:
            features[i, _PLACE[name]] = 1
        if joined[i]:
            features[i - 1, _PLACE["before_node"]] = 1
        own = [token.lower()] if len(token) >= 5 else []
        own += [token.lower().split("@")[0]] if "@" in token and len(token.split("@")[0]) >= 5 else []
        own += [digits[-7:]] if len(digits) >= 7 else []
        keys.append(list(dict.fromkeys(own)))
    return Nodes(spans, features, joined, keys)


def first_over(spans: list[tuple[int, int]], base: list[Span]) -> Iterator[Span | None]:
    """For each of ``spans`` (ascending, apart) the first base span over it; one walk over both lists."""
    at = 0
    for start, end in spans:
        while at < len(base) and base[at][2] <= start:
            at += 1
        yield base[at] if at < len(base) and base[at][1] < end else None


def observed(nodes: Nodes, base: list[Span]) -> np.ndarray:
    """Label number of the base span that covers each token, 0 where none does."""
    over = first_over(nodes.spans, base)
    return np.array([LABELS.index(s[0]) if s else 0 for s in over], np.int64)


# --- the model ----------------------------------------------------------------------------------------


class Model(NamedTuple):
    weights: np.ndarray  # features x labels
    steps: np.ndarray  # log potential of (label, next label) on joined tokens
    skip: float


def prior() -> Model:
    """What holds without data: shapes speak for their kinds, labels tend to go on."""
    weights = np.zeros((len(FEATURES), len(LABELS)))
    for feature, label, value in (
        ("always", "none", 1.0),
        ("address", "email", 3.0),
        ("quad", "ip", 3.0),
        ("luhn", "card", 2.0),
        ("plus", "phone", 2.0),
        ("after_plus", "phone", 1.0),
        ("letters", "none", 1.0),
    ):
        weights[_PLACE[feature], LABELS.index(label)] = value
    return Model(weights, np.eye(len(LABELS)), SKIP_WEIGHT)


def fit(features: np.ndarray, labels: np.ndarray, pairs: np.ndarray, rounds: int = 300, rate: float = 0.5) -> Model:
    """Multinomial logistic weights pulled to the prior, and smoothed log transition odds."""
    start = prior()
    weights = start.weights.copy()
    if len(labels):
        target = np.eye(len(LABELS))[labels]
        for _ in range(rounds):
            score = features @ weights
            share = np.exp(score - score.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            gradient = features.T @ (share - target) / len(labels) + 0.01 * (weights - start.weights)
            weights -= rate * gradient
    counts = np.ones((len(LABELS), len(LABELS))) + np.eye(len(LABELS))
    for a, b in pairs:
        counts[a, b] += 1
    odds = counts / counts.sum(axis=1, keepdims=True)
    return Model(weights, np.log(odds * len(LABELS)), SKIP_WEIGHT)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the bounded sample; the prior where there is nothing to fit on."""
    digit = docs.filter(F.col(text_col).rlike("[@0-9]"))
    hashed = digit.filter(F.col(id_col).isNotNull()).select(
        F.xxhash64(id_col, text_col).alias("doc"), F.col(text_col).alias("text")
    )
    picked = [r[0] for r in hashed.select("doc").distinct().orderBy("doc").limit(SAMPLE_DOCS).collect()]
    if not picked:
        return prior()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, before, spots = [], [], [], []
            for text in batch.column("text").to_pylist():
                nodes = nodes_of(text)
                seen = observed(nodes, base_spans(text))
                rows += [np.flatnonzero(f).tolist() for f in nodes.features]
                labels += seen.tolist()
                before += [int(seen[i - 1]) if nodes.joined[i] else -1 for i in range(len(seen))]
                spots.append(range(len(seen)))
            docs_ = batch.column("doc").take(pa.array(np.repeat(np.arange(len(spots)), [len(s) for s in spots])))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.list_(pa.int64())),
                    pa.array(labels, pa.int64()),
                    pa.array(before, pa.int64()),
                    docs_,
                    pa.array([i for s in spots for i in s], pa.int64()),
                ],
                ["on", "label", "before", "doc", "spot"],
            )

    # Repeated rows count once; the order of the cut knows nothing of labels.
    sample = hashed.filter(F.col("doc").isin(picked)).groupBy("doc").agg(F.min("text").alias("text"))
    tokens = map_batches(sample, run, "on array<bigint>, label bigint, before bigint, doc bigint, spot bigint")
    tokens = tokens.orderBy(F.xxhash64("doc", "spot"), "doc", "spot").limit(SAMPLE_TOKENS).collect()
    features = np.zeros((len(tokens), len(FEATURES)))
    for i, r in enumerate(tokens):
        features[i, r["on"]] = 1
    labels = np.array([r["label"] for r in tokens], np.int64)
    pairs = np.array([(r["before"], r["label"]) for r in tokens if r["before"] >= 0], np.int64).reshape(-1, 2)
    return fit(features, labels, pairs)


def skip_hubs(keys: list[list[str]]) -> list[list[int]]:
    """The tokens of each key that repeats; keys of the same tokens count once."""
    places: dict[str, list[int]] = {}
    for i, own in enumerate(keys):
        for key in own:
            places.setdefault(key, []).append(i)
    return [list(p) for p in dict.fromkeys(tuple(p) for p in places.values() if len(p) > 1)]


def beliefs(unary: np.ndarray, links: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label shares of each node by damped loopy sum-product; exact where the links form a tree.

    ``potentials[k]``: log potential of (label of links[k, 0], label of links[k, 1]).
    """
    n, labels = unary.shape
    m = len(links)
    source = np.concatenate([links[:, 0], links[:, 1]])
    target = np.concatenate([links[:, 1], links[:, 0]])
    both = np.concatenate([potentials, potentials.transpose(0, 2, 1)]) if m else np.zeros((0, labels, labels))
    message = np.zeros((2 * m, labels))
    for turn in range(max(rounds, 1) if m else 0):
        total = unary.copy()
        np.add.at(total, target, message)
        reverse = np.concatenate([message[m:], message[:m]])
        given = (total[source] - reverse)[:, :, None] + both
        top = given.max(axis=1, keepdims=True)
        sent = np.log(np.exp(given - top).sum(axis=1)) + top[:, 0]
        sent -= sent.max(axis=1, keepdims=True)
        moved = np.abs(sent - message).max()
        message = sent if turn < 2 else 0.5 * (sent + message)
        if moved < 1e-6:
            break
    total = unary.copy()
    np.add.at(total, target, message)
    share = np.exp(total - total.max(axis=1, keepdims=True))
    return share / share.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Spans that the field finds outside the base spans."""
    nodes = nodes_of(text)
    n = len(nodes.spans)
    if not n:
        return []
    seen = observed(nodes, base)
    unary = nodes.features @ model.weights
    unary[np.flatnonzero(seen), seen[seen > 0]] += EVIDENCE
    chain = np.flatnonzero(nodes.joined)
    hubs = skip_hubs(nodes.keys)
    of_hubs = np.zeros((len(hubs), len(LABELS)))
    for hub, tokens in zip(of_hubs, hubs, strict=True):
        given = np.bincount(seen[tokens], minlength=len(LABELS))[1:]
        # Stronger than what all its tokens can send.
        hub[1:] = given / max(1, given.sum()) * (EVIDENCE + model.skip * len(tokens))
    unary = np.concatenate([unary, of_hubs])
    skips = np.array([(n + k, i) for k, tokens in enumerate(hubs) for i in tokens], np.int64).reshape(-1, 2)
    links = np.concatenate([np.stack([chain - 1, chain], axis=1), skips])
    potentials = np.concatenate(
        [
            np.repeat(model.steps[None], len(chain), axis=0),
            np.repeat(model.skip * np.eye(len(LABELS))[None], len(skips), axis=0),
        ]
    )
    share = beliefs(unary, links, potentials)[:n]
    label = share.argmax(axis=1)
    label[(share.max(axis=1) < LEAST_BELIEF) | (seen > 0)] = 0
    found, i = [], 0
    while i < n:
        j = i
        while j + 1 < n and nodes.joined[j + 1] and label[j + 1] == label[i] and label[i]:
            j += 1
        kind, (start, end) = LABELS[label[i]], (nodes.spans[i][0], nodes.spans[j][1])
        if label[i] and len(DIGIT.findall(text[start:end])) >= LEAST_DIGITS[kind]:
            found.append((kind, start, end))
        i = j + 1
    over = first_over([(s, e) for _, s, e in found], base)
    return [span for span, taken in zip(found, over, strict=True) if not taken]


def scan(text: str, model: Model) -> list[tuple[str, int, int, bool]]:
    base = base_spans(text)
    found = [(*s, True) for s in base]
    found += [(*s, False) for s in added_spans(text, base, model)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def find_personal(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id`` and ``spans`` (kind, start, end, base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        )
        names = ("kind", "start", "end", "base")
        for batch in batches:
            spans = [
                [dict(zip(names, s, strict=True)) for s in scan(text or "", model)]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(narrow, run, f"doc_id {dict(narrow.dtypes)['doc_id']}, spans {SPANS}")


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans count as the first."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask_personal(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all spans masked in the text; a null text stays null."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if t is None else masked(t, spans) if (spans := scan(t, model)) else t
                for t in batch.column(place).to_pylist()
            ]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return map_batches(docs, run, docs.schema)
