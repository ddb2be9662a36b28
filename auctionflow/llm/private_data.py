"""Personal data: rules, and a skip-chain conditional random field for what the rules miss.

Base findings follow four fixed rules.  The field's nodes are the tokens of a
text that hold a digit or an at sign (long ones are cut at characters that no
finding can hold); its labels are the four kinds and none.
Neighbouring nodes share a transition potential.  Nodes whose tokens are equal,
or alike (the same last seven digits, or the same letters and digits), share an agreement potential however far
apart they stand: each occurrence is joined to the next one, so a group of n
tokens has n - 1 edges and evidence travels along them.  Damped loopy belief
propagation runs over all edges of a document at once in numpy, and nodes whose
belief in a kind reaches ``BELIEF`` add spans where no base finding is.

Training is piecewise: a softmax regression for the node potentials, counts of
label pairs for the two kinds of edges (and a prior for alike tokens, which never speak
against each other's label), on the base findings of a bounded sample
of documents and of drawn texts.  Tokens that are like a finding without being one
by the rules (a phone number without its plus sign) count as unknown there: they
are what the field is to decide.

Null and empty texts have no findings.  Repeated rows give a row each.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
MASKED = "doc_id bigint, masked string"
KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
UNKNOWN = NONE + 1
BELIEF = 0.9
#: Sweeps (and one more for each node), the change of a message that counts as none, and damping of sweeps that don't settle.
SWEEPS, SETTLED, DAMPED_FROM, DAMPING = 50, 1e-5, 20, 0.5
# Fixed values of the base rules.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\s|,;<>\"'\[\]{}]+")
_MARK = re.compile("[0-9@]")
_PART = re.compile(r"[A-Za-z0-9._%+@()-]+")
LONG = 200


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Equal to the pattern's matches: only a run before an at sign can begin one."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by kind as listed, then start."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = re.sub("[^0-9]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return out


@dataclass
class Graph:
    """Nodes (places in the text), features, and edges by kind."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1] in ".:!?)(":
        if text[b - 1] == ")" and "(" in text[a:b]:
            break
        b -= 1
    return a, b


def _nodes(text: str) -> Iterator[tuple[int, int]]:
    """Tokens; those of over ``LONG`` characters are cut where a character can't belong to a finding."""
    for m in _TOKEN.finditer(text):
        if m.end() - m.start() <= LONG:
            yield m.span()
        elif _MARK.search(m[0]):
            yield from (p.span() for p in _PART.finditer(text, *m.span()))


def graph(text: str) -> Graph | None:
    spans = [s for a, b in _nodes(text) if _MARK.search(text, a, b) and (s := _trimmed(text, a, b))[1] > s[0]]
    if not spans:
        return None
    rows, chain, skip = [], [], []
    last: dict[tuple[str, str], int] = {}
    for i, (a, b) in enumerate(spans):
        t = text[a:b]
        digits = re.sub("[^0-9]", "", t)
        letters = sum(c.isalpha() for c in t)
        size = 0 if letters else len(digits)
        prior = text[max(0, a - 2) : a]
        rows.append(
            [
                1.0, "@" in t, bool(re.fullmatch(r"[^@]+@[^@]+\.[^@.]+", t)), t.count(".") == 3, bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", t)),
                t.startswith("+"), "(" in t, t.count("-") == 1, t.count("-") > 1, letters == 0, min(letters / len(t), 1), 1 <= size <= 2, 3 <= size <= 4,
                5 <= size <= 8, 9 <= size <= 12, 13 <= size <= 19, size > 19, 13 <= size <= 19 and luhn(digits),
                bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", t)), bool(re.fullmatch(r"\([0-9]{3}\)", t)), bool(re.fullmatch(r"\+[0-9]{1,3}", t)), "+" in prior, ")" in prior,
            ]
        )
        if i and a - spans[i - 1][1] <= 2:
            chain.append((i - 1, i))
        alike = [("same", re.sub(r"\W", "", t).lower())]
        if len(digits) >= 7:
            alike.append(("tail", digits[-7:]))
        seen = set()
        for key in alike:
            if (j := last.get(key)) is not None and j not in seen:
                seen.add(j)
                skip.append((j, i))
            last[key] = i
    return Graph(spans, np.array(rows, float), np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))


@dataclass
class Field:
    """Node weights (features x labels) and log potentials of the edges (labels x labels)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, g: Graph) -> np.ndarray:
        """Marginals of each node by loopy belief propagation."""
        z = g.features @ self.node
        phi = np.exp(z - z.max(axis=1, keepdims=True))
        phi /= phi.sum(axis=1, keepdims=True)
        if not len(g.chain) + len(g.skip):
            return phi
        edges = np.concatenate([g.chain, g.skip])
        psi = [np.exp(self.chain), np.exp(self.skip)]
        psi += [p.T for p in psi]
        order = np.lexsort((edges[:, 0], edges[:, 1]))
        # message 2e goes forwards along edge e, 2e + 1 backwards
        source, target = np.stack([edges[:, 0], edges[:, 1]], 1).ravel().tolist(), np.stack([edges[:, 1], edges[:, 0]], 1).ravel().tolist()
        forwards = (2 * order).tolist()
        backwards = (2 * np.lexsort((edges[:, 1], edges[:, 0]))[::-1] + 1).tolist()
        leaving: list[list[int]] = [[] for _ in phi]
        for m, i in enumerate(source):
            leaving[i].append(m)
        belief = list(phi + 1e-12)
        message = [np.full(NONE + 1, 1 / (NONE + 1))] * len(source)
        due = [True] * len(source)
        for sweep in range(SWEEPS + len(phi)):
            if not any(due):
                break
            for m in (*forwards, *backwards):
                if not due[m]:
                    continue
                due[m] = False
                old, t = message[m], target[m]
                new = (belief[source[m]] / message[m ^ 1]) @ psi[(m // 2 >= len(g.chain)) + 2 * (m & 1)]
                new /= new.sum()
                if sweep >= DAMPED_FROM:
                    new = DAMPING * old + (1 - DAMPING) * new
                if np.abs(new - old).max() < SETTLED:
                    continue
                message[m] = new
                sent = belief[t] * (new / old)
                belief[t] = sent / sent.sum()
                for k in leaving[t]:
                    if k != m ^ 1:
                        due[k] = True
                due[m] = sweep >= DAMPED_FROM  # only part of the way
        return np.array(belief) / np.sum(belief, axis=1, keepdims=True)


def _gold(g: Graph, found: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.full(len(g.spans), NONE)
    for i, (a, b) in enumerate(g.spans):
        for s, e, kind in found:
            if a < e and s < b:
                y[i] = KINDS.index(kind)
                break
    for i, j in g.skip[::-1]:  # like a finding, but not one by the rules: unknown
        if y[j] < NONE and y[i] == NONE:
            y[i] = UNKNOWN
    for i, j in g.skip:
        if y[i] < NONE and y[j] == NONE:
            y[j] = UNKNOWN
    return y


def _drawn(seed: int, n: int) -> list[str]:
    """Texts with findings of each kind, repeated in other written forms, among numbers that are none."""
    rng = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def card() -> str:
        body = d(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    out = []
    for _ in range(n):
        area, tail = d(3), f"{d(3)}-{d(4)}"
        mail = f"user{d(2)}@mail{d(1)}.example.com"
        ip = ".".join(str(x) for x in rng.integers(0, 256, 4))
        c = card()
        parts = [f"+1 ({area}) {tail}", mail, ip, c, d(3), d(4), f"v{d(1)}.{d(1)}", d(12), f"20{d(2)}-{d(2)}", "a" + d(6), d(16), f"+{d(2)} {d(3)} {d(6)}"]
        out.append(" word ".join(parts[i] for i in rng.permutation(len(parts))[:8]))
    return out


def fit(texts: list[str], drawn: int = 300, steps: int = 300, rate: float = 0.5) -> Field:
    graphs = [(g, _gold(g, base_spans(t))) for t in [*texts, *_drawn(4, drawn)] if (g := graph(t)) is not None]
    x = np.concatenate([g.features for g, _ in graphs])
    y = np.concatenate([y for _, y in graphs])
    x, y = x[y != UNKNOWN], y[y != UNKNOWN]
    n = NONE + 1
    target = np.eye(n)[y]
    weight = (len(y) / n / np.maximum(target.sum(axis=0), 1))[y] ** 0.5
    weight /= weight.sum()
    w = np.zeros((x.shape[1], n))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * 4 * (x.T @ ((p - target) * weight[:, None]) + 1e-5 * w)

    def pair(kind: str) -> np.ndarray:
        """Log of how much oftener than by chance the labels of an edge go together, drawn towards chance where counts are few."""
        count = np.zeros((n, n))
        for g, labels in graphs:
            e = getattr(g, kind)
            e = e[(labels[e] != UNKNOWN).all(axis=1)]
            np.add.at(count, (labels[e[:, 0]], labels[e[:, 1]]), 1)
        chance = np.outer(count.sum(axis=1) + 1, count.sum(axis=0) + 1)
        chance *= max(count.sum(), 1) / chance.sum()
        return np.clip(np.log((count + 3 * chance / chance.max() + 0.5) / (chance + 3 * chance / chance.max() + 0.5)), -3, 3)

    chain, skip = pair("chain"), pair("skip")
    # alike tokens never speak against each other's label: agreement at least neutral, disagreement at most
    skip = np.where(np.eye(n, dtype=bool), np.maximum((skip + skip.T) / 2, 1.0), np.minimum((skip + skip.T) / 2, 0.0))
    return Field(w, chain, skip)


def _fits(kind: str, written: str) -> bool:
    """Whether characters are a whole card or phone number by their digits."""
    digits = "".join(c for c in written if "0" <= c <= "9")
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _findings(text: str, nodes: list[tuple[int, int]], k: int) -> list[tuple[int, int, str]]:
    """What neighbouring nodes of one label stand for.

    Mail and network addresses are a node each.  Card and phone numbers may be
    written in several nodes: the nodes are cut into whole numbers so that as few digits as
    can be are left over, and then into as many numbers as can be.  A node that is left over is
    a finding alone if it is a local phone number, of 7 digits or more.
    """
    if not nodes:
        return []
    kind = KINDS[k]
    if kind in ("email", "ip"):
        return [(a, b, kind) for a, b in nodes]
    digits = [sum("0" <= c <= "9" for c in text[a:b]) for a, b in nodes]
    most = 19 if kind == "card" else 15
    best: list[tuple[int, int, int]] = [(0, 0, 0)]  # from a node on: digits left over, minus the numbers, nodes of the first number
    for i in range(len(nodes) - 1, -1, -1):
        rest = best[-1]
        ways = [(rest[0] + digits[i], rest[1], 0)]
        n = 0
        for j in range(i, len(nodes)):
            n += digits[j]
            if n > most or j - i > most:
                break
            if _fits(kind, text[nodes[i][0] : nodes[j][1]]):
                then = best[len(nodes) - 1 - j]
                ways.append((then[0], then[1] - 1, j - i + 1))
        best.append(min(ways))
    out, i = [], 0
    while i < len(nodes):
        size = best[len(nodes) - i][2]
        if size or (kind == "phone" and 7 <= digits[i] <= most):
            out.append((nodes[i][0], nodes[i + max(size, 1) - 1][1], kind))
        i += max(size, 1)
    return out


def spans(text: str, field: Field, base: list[tuple[int, int, str]] | None = None) -> tuple[list[tuple[int, int, str]], int]:
    """All findings by kind as listed, then start; how many the field added.  ``base``: the base findings, if they are known."""
    base = base_spans(text) if base is None else base
    if not _DIGIT.search(text) and "@" not in text:
        return base, 0
    g = graph(text)
    if g is None:
        return base, 0
    best = field.beliefs(g)
    taken = sorted((a, b) for a, b, _ in base)
    starts = np.array([a for a, _ in taken])
    top = np.maximum.accumulate([b for _, b in taken]) if taken else []
    added: list[tuple[int, int, str]] = []
    together: list[tuple[int, int]] = []
    kind = NONE
    for i, (a, b) in enumerate(g.spans):
        k = int(best[i].argmax())
        j = int(np.searchsorted(starts, b)) - 1
        if k == NONE or best[i, k] < BELIEF or (j >= 0 and top[j] > a):
            continue
        if k != kind or a - together[-1][1] > 2 or (j >= 0 and taken[j][0] >= together[-1][1]):
            added += _findings(text, together, kind)
            together, kind = [], k
        together.append((a, b))
    added += _findings(text, together, kind)
    return sorted([*base, *added], key=lambda s: (KINDS.index(s[2]), s[0])), len(added)


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def train(docs: DataFrame, rows: int = 3000, max_bytes: int = 8_000_000) -> Field:
    sample = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text", F.lit(1).alias("g"))
    field = fit([r["text"] for r in common.bounded_sample(sample, "doc_id", "g", rows, max_bytes, seed=4)])
    common.release()  # the driver works on beside its model
    return field


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    field = docs.sparkSession.sparkContext.broadcast(field or train(docs))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_added": []}
        for text in common.texts(batch):
            base = base_spans(text)
            found, n = spans(text, field.value, base)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(common.sha256_hex(written(base)))
            out["spans"].append(written(found))
            out["n_added"].append(n)
        return {"doc_id": batch.column(0), **out}

    return common.map_text(docs.select("doc_id", "text"), FOUND, work)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each finding replaced by its kind in brackets; findings that overlap become one."""
    out, at = [], 0
    for a, b, kind in sorted(found):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with findings masked in ``text``; null stays null, other columns stay as they are."""
    common.small_batches(docs.sparkSession)
    trained = docs.sparkSession.sparkContext.broadcast(field or train(docs))

    def hide(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masked(t, spans(t, trained.value)[0]) for t in column.to_pylist()], column.type)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([hide(c) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(common.released(run), docs.schema)
