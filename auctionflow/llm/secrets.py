"""Secret scans: rules, and a character convolutional network over candidates in context.

Base findings follow three fixed rules (assignments, access keys, long
hexadecimal runs).  Candidates of the network are runs of six or more key characters
that hold a letter and a digit, their parts between = and /, and runs of eight or more with signs inside, where no base finding is.  It reads
each candidate through a window that slides over all of it, with the text before
and after, and the largest score counts: embedding, one convolution with a ReLU, the maximum
over the candidate and over its surroundings, a hidden layer, a logistic output,
all in numpy.

It is trained on labelled findings: the base findings (the value alone, without the
keyword) of a bounded sample of documents, those of its other runs that are made of
words of the sample and numbers, and drawn findings of known kinds (credentials of
several alphabets in assignments and URLs against identifiers, dates, paths,
numbers and prose), put into contexts.  A held-out third of the findings
calibrates the scores (isotonic) and sets the threshold: the largest one that
keeps ``recall`` of the held-out secrets of each kind, whatever precision that
leaves; both figures stay with the network.

Null and empty texts have no findings.  A score at the threshold is accepted.  Of
accepted runs that overlap the first counts, of those that begin together the longest.  Repeated rows give a row each.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .boosting import isotonic

FOUND = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint"
KINDS = ("assign", "access", "hex", "model")
# Fixed values of the base rules.
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A run of key characters, and what it is cut into besides.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
_PART = re.compile(r"[A-Za-z0-9+_-]{6,}")
_DOMAIN = re.compile(r"\.[A-Za-z0-9]")
#: A run with signs between its characters, as passwords have them.
SIGNS = "!@#$%^&*?~"
_SIGNED = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_=-]|[!@#$%^&*?~](?=[!@#$%^&*?~]*[A-Za-z0-9+/_=-])){7,}")
_LETTER = re.compile("[A-Za-z]")
_DIGIT = re.compile("[0-9]")

BEFORE, INSIDE, AFTER = 20, 40, 8
#: From one window of a long candidate to the next.
STRIDE = 8
LENGTH = BEFORE + INSIDE + AFTER
_CODE = {c: i + 2 for i, c in enumerate(string.ascii_letters + string.digits + "+/_=-.:;\"'@#$%&*()[]{}<> \n\\|,!?~")}
_SYMBOLS = len(_CODE) + 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _DIGIT.search(text) or len(text) >= 24:
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs with a letter and a digit, their parts between = and /, and such runs with signs in them, that no base finding touches."""
    out = []
    if not _DIGIT.search(text):
        return out
    starts = [a for a, _, _ in taken]  # in order
    ends = list(accumulate((b for _, b, _ in taken), max))
    for m in _RUN.finditer(text):
        if not (_DIGIT.search(m[0]) and _LETTER.search(m[0])):
            continue
        parts = [m.span()]
        if "=" in m[0] or "/" in m[0]:
            parts += [p.span() for p in _PART.finditer(text, *m.span()) if p.span() != m.span() and _DIGIT.search(p[0]) and _LETTER.search(p[0])]
        out += parts
    if any(c in text for c in SIGNS):
        signed = (m for m in _SIGNED.finditer(text) if not ("@" in m[0] and _DOMAIN.match(text, m.end())))  # no part of a mail address
        out += [m.span() for m in signed if not _RUN.fullmatch(m[0]) and _DIGIT.search(m[0]) and _LETTER.search(m[0])]
    return [(s, e) for s, e in out if not (i := bisect_left(starts, e)) or ends[i - 1] <= s]


def plainly_none(body: str, vocabulary: set[str]) -> bool:
    """Few different characters, or nothing but words of the corpus and numbers."""
    return len(set(body)) < 8 or all(len(w) < 2 or w.lower() in vocabulary for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", body))


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the surroundings and the first characters of a finding; 0 is beyond the text, 1 any other character."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    return np.array([0 if c == "\0" else _CODE.get(c, 1) for c in before + inside + after], np.uint8)


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """A window for each place of a candidate, its last characters included."""
    last = max(start, end - INSIDE)
    return [window(text, at, end) for at in [*range(start, last, STRIDE), last]]


@dataclass
class Network:
    """Weights by name, the calibration, the threshold and what it gave on held-out findings."""

    w: dict[str, np.ndarray]
    centres: np.ndarray
    means: np.ndarray
    threshold: float = 1.0
    #: Of held-out findings: recall of the worst kind, precision of all.
    recall: float = float("nan")
    precision: float = float("nan")

    WIDTH = 5

    @classmethod
    def drawn(cls, seed: int, embed: int = 8, filters: int = 24, hidden: int = 16) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        w = {"embed": rng.normal(0, 0.5, (_SYMBOLS, embed)), "conv": normal(cls.WIDTH * (embed + 1), filters), "conv_b": np.zeros(filters), "hid": normal(2 * filters, hidden), "hid_b": np.zeros(hidden), "out": normal(hidden, 1), "out_b": np.zeros(1)}
        return cls({k: v.astype(np.float32) for k, v in w.items()}, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, k = self.w, self.WIDTH
        part = np.zeros(LENGTH, np.float32)
        part[BEFORE : BEFORE + INSIDE] = 1.0
        e = np.concatenate([w["embed"][x], np.broadcast_to(part[None, :, None], (*x.shape, 1))], axis=2)
        n = LENGTH - k + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(k)], axis=2)
        act = np.maximum((cols.reshape(-1, cols.shape[2]) @ w["conv"]).reshape(*cols.shape[:2], -1) + w["conv_b"], 0)
        split = BEFORE - k // 2, BEFORE + INSIDE - k // 2
        inner = act[:, split[0] : split[1]]
        outer = np.concatenate([act[:, : split[0]], act[:, split[1] :]], axis=1)
        at_in, at_out = inner.argmax(axis=1), outer.argmax(axis=1)
        pooled = np.concatenate([inner.max(axis=1), outer.max(axis=1)], axis=1)
        hid = np.maximum(pooled @ w["hid"] + w["hid_b"], 0)
        z = (hid @ w["out"] + w["out_b"])[:, 0]
        return z, (x, cols, act, split, at_in, at_out, pooled, hid)

    def gradients(self, dz: np.ndarray, cache: tuple) -> dict[str, np.ndarray]:
        w, k = self.w, self.WIDTH
        x, cols, act, split, at_in, at_out, pooled, hid = cache
        g = {"out": hid.T @ dz[:, None], "out_b": dz.sum(keepdims=True)}
        dh = dz[:, None] @ w["out"].T * (hid > 0)
        g["hid"], g["hid_b"] = pooled.T @ dh, dh.sum(axis=0)
        dp = dh @ w["hid"].T
        filters = dp.shape[1] // 2
        da = np.zeros_like(act)
        row, col = np.arange(len(x))[:, None], np.arange(filters)[None, :]
        da[row, at_in + split[0], col] += dp[:, :filters]
        da[row, np.where(at_out < split[0], at_out, at_out - split[0] + split[1]), col] += dp[:, filters:]
        da *= act > 0
        g["conv"] = cols.reshape(-1, cols.shape[2]).T @ da.reshape(-1, filters)
        g["conv_b"] = da.sum(axis=(0, 1))
        dcols = (da.reshape(-1, filters) @ w["conv"].T).reshape(*da.shape[:2], -1)
        size = w["embed"].shape[1]
        de = np.zeros((*x.shape, size), np.float32)
        for i in range(k):
            de[:, i : i + dcols.shape[1]] += dcols[:, :, i * (size + 1) : i * (size + 1) + size]
        flat, de = x.reshape(-1), de.reshape(-1, size)
        g["embed"] = np.stack([np.bincount(flat, de[:, j], len(w["embed"])) for j in range(size)], axis=1)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 4e-3, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(y), min(batch, len(y)))
            z, cache = self.forward(x[pick])
            dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
            for k, g in self.gradients(dz, cache).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, kind: np.ndarray) -> None:
        """The largest threshold that ``recall`` of the secrets of each kind reach; what it costs is kept in ``precision``."""
        z = self.forward(x)[0]
        self.centres, self.means = isotonic(z, y)
        p = self.score(x)
        best = 1.0
        for k in np.unique(kind[y == 1]):
            own = np.sort(p[(y == 1) & (kind == k)])[::-1]
            best = min(best, own[int(np.ceil(recall * len(own) - 1e-9)) - 1])
        self.threshold = float(best)
        took = p >= best
        self.recall = min((float(took[(y == 1) & (kind == k)].mean()) for k in np.unique(kind[y == 1])), default=float("nan"))
        self.precision = float(y[took].mean()) if took.any() else float("nan")

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = self.forward(x)[0]
        return np.clip(0.99 * np.interp(z, self.centres, self.means) + 0.01 / (1 + np.exp(-np.clip(z, -30, 30))), 0, 1)


def drawn_findings(n: int, seed: int, prose: list[str]) -> tuple[list[np.ndarray], list[int]]:
    """Windows and labels of findings of known kinds, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    run = lambda alphabet, a, b: "".join(pick(alphabet) for _ in range(int(rng.integers(a, b))))
    words = [w for t in prose for w in re.findall(r"[a-z]{3,}", t.lower())] or "the of and to in is that it was for on are as with at be this have from or one had by word but not what all were we when".split()
    around = lambda: " ".join(pick(words) for _ in range(int(rng.integers(1, 6))))
    names = "key auth credential private access client session signing aws github db bearer pwd".split()
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits

    def secret() -> tuple[str, str, str]:
        body = pick([lambda: run(hexa, 32, 65), lambda: run(hexa.upper(), 32, 65), lambda: run(alnum + "+/", 24, 60) + pick(["", "=", "=="]), lambda: run(alnum, 20, 48), lambda: run(alnum + "_-", 24, 44), lambda: "AKIA" + run(string.ascii_uppercase + string.digits, 16, 17), lambda: "sk_live_" + run(alnum, 20, 30), lambda: "-".join(run(hexa, k, k + 1) for k in (8, 4, 4, 4, 12))])()
        before = pick([lambda: f"{pick(names)}{pick(['', '_key', '_token', '-id'])}{pick([' = ', '=', ': ', ':'])}{pick(['', chr(34), chr(39)])}", lambda: "Authorization: Bearer ", lambda: around() + " "])()
        return around() + " " + before, body, pick(["", '"', "'", "\n"]) + " " + around()

    def plain() -> tuple[str, str, str]:
        number = lambda: str(int(rng.integers(1, 3000)))
        body = pick(
            [
                lambda: "_".join(pick(words) for _ in range(4)) + "_" + number(),
                lambda: "/".join(pick(words) for _ in range(5)) + "/" + number(),
                lambda: "-".join(pick(words) for _ in range(4)) + "-" + number(),
                lambda: f"20{run('012', 2, 3)}-0{run('123', 1, 2)}-1{run('012', 1, 2)}T{run('012', 2, 3)}-{run('012345', 2, 3)}-00Z-" + pick(words),
                lambda: "".join(pick(words).capitalize() for _ in range(4)) + number(),
                lambda: pick(words) + pick("-=_") * int(rng.integers(16, 40)) + number(),
                lambda: "".join(pick(words) for _ in range(5)) + number(),
                lambda: pick("abcx") * int(rng.integers(20, 50)) + number(),
            ]
        )()
        return around() + pick([" ", " see ", " (", ": ", "/"]), body.ljust(20, "x"), pick([" ", ", ", ").", "\n"]) + around()

    x, y = [], []
    for i in range(n):
        before, body, after = secret() if i % 2 else plain()
        x.append(window(before + body + after, len(before), len(before) + len(body)))
        y.append(i % 2)
    return x, y


def drawn_short(n: int, seed: int) -> tuple[list[np.ndarray], list[int]]:
    """The same for findings of 8 to 19 characters: passwords against words with numbers, versions, dates and amounts."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    run = lambda alphabet, a, b: "".join(pick(alphabet) for _ in range(int(rng.integers(a, b))))
    words = "part section figure table version model route flight room page item report order chapter record volume series build window student".split()
    number = lambda: str(int(rng.integers(1, 3000)))
    x, y = [], []
    for i in range(n):
        if i % 2:
            body = run(string.ascii_letters, 1, 6) + run(string.digits, 1, 3) + run(string.ascii_letters + string.digits, 6, 11)
            before = pick(["pwd ", "pwd=", "pass: ", "login ", "key ", "credential "])
        else:
            body = pick([lambda: pick(words) + number(), lambda: pick(words) + pick("-_/") + number(), lambda: number() + pick(["th", "km", "mb", "px"]) + "-" + pick(words), lambda: f"20{run('012', 2, 3)}-0{run('123', 1, 2)}-1{run('012', 1, 2)}T{run('012', 2, 3)}", lambda: pick(words) + "-" + pick(words) + number()])().ljust(6, "x")
            before = pick(["the ", "see ", "in ", "of ", "a "])
        before, after = pick(words) + " " + before, pick([" ", ", ", "\n"]) + pick(words)
        x.append(window(before + body + after, len(before), len(before) + len(body)))
        y.append(i % 2)
    return x, y


def drawn_signed(n: int, seed: int) -> tuple[list[np.ndarray], list[int]]:
    """The same for findings with signs in them: passwords against addresses, parameters, marked words and amounts."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    run = lambda alphabet, a, b: "".join(pick(alphabet) for _ in range(int(rng.integers(a, b))))
    words = "part section figure table version model route flight room page item report order chapter record volume series build window student".split()
    number = lambda: str(int(rng.integers(1, 3000)))
    x, y = [], []
    for i in range(n):
        if i % 2:
            body = list(run(string.ascii_letters + string.digits, 6, 14))
            for c in (pick(string.ascii_letters), pick(string.digits), *(pick(SIGNS) for _ in range(int(rng.integers(1, 4))))):
                body.insert(int(rng.integers(1, len(body))), c)
            body, before = "".join(body), pick(["pwd ", "pwd=", "pass: ", "login ", "key ", "credential ", "use ", "cred: ", ""])
        else:
            named = lambda: pick(words) + pick(["", "", number()])
            body = pick([lambda: f"{named()}{number()}@{named()}", lambda: f"{named()}={number()}&{named()}={named()}", lambda: f"{named()}**{named()}{number()}", lambda: f"{named()}#{number()}-{named()}", lambda: f"{named()}{pick('$%')}{number()}", lambda: f"{named()}?{named()}={number()}", lambda: f"{named()}!{named()}{number()}", lambda: f"{named()}~{number()}{pick(words)}"])()
            before = pick(["the ", "see ", "in ", "of ", "a ", "mail ", "key "])
        before, after = pick(words) + " " + before, pick([" ", ", ", "\n"]) + pick(words)
        x.append(window(before + body + after, len(before), len(before) + len(body)))
        y.append(i % 2)
    return x, y


def fit(texts: list[str], drawn: int = 3000, recall: float = 0.98, seed: int = 11) -> Network:
    parts = {"drawn": drawn_findings(drawn, seed, texts[:200]), "short": drawn_short(drawn // 3, seed), "signed": drawn_signed(drawn // 3, seed)}
    x, y = ([v for part in parts.values() for v in part[j]] for j in (0, 1))
    kind = [name for name, part in parts.items() for _ in part[1]]
    vocabulary = {w for t in texts for w in re.findall(r"\b[a-z]{2,}\b", t)}
    for t in texts:
        base = base_spans(t)
        for a, b, k in base:
            a = _ASSIGN.match(t, a).start(2) if k == "assign" else a  # candidates hold no keyword
            x.append(window(t, a, b))
            y.append(1)
            kind.append(k)
        for a, b in candidates(t, base):
            if plainly_none(t[a:b], vocabulary):
                own = windows(t, a, b)
                x += own
                y += [0] * len(own)
                kind += ["none"] * len(own)
    x, y, kind = np.stack(x), np.array(y, float), np.array(kind)
    held = np.arange(len(y)) % 3 == 2
    order = np.random.default_rng(seed).permutation(len(y))
    x, y, kind = x[order], y[order], kind[order]
    network = Network.drawn(seed)
    network.train(x[~held], y[~held])
    network.calibrate(x[held], y[held], recall, kind[held])
    return network


def spans(texts: list[str], network: Network) -> list[list[tuple[int, int, str]]]:
    """All findings of each text: base ones, and candidates of which the network accepts a window, the longest of those that overlap."""
    base = [base_spans(t) for t in texts]
    accepted: list[list[tuple[int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, int, np.ndarray]] = []

    def decide() -> None:
        took = network.score(np.stack([w for *_, w in held])) >= network.threshold
        for (i, a, b, _), yes in zip(held, took):
            if yes:
                accepted[i].append((a, b))
        held.clear()

    for i, t in enumerate(texts):
        for a, b in candidates(t, base[i]):
            for w in windows(t, a, b):
                held.append((i, a, b, w))
                if len(held) == 1000:
                    decide()
    if held:
        decide()
    for found, own in zip(base, accepted):  # a part of an accepted run is no finding of its own
        end = -1
        for a, b in sorted(set(own), key=lambda s: (s[0], -s[1])):
            if a >= end:
                found.append((a, b, "model"))
                end = b
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in base]


def written(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def train(docs: DataFrame, rows: int = 2000, max_bytes: int = 8_000_000) -> Network:
    sample = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text", F.lit(1).alias("g"))
    return fit([r["text"] for r in common.bounded_sample(sample, "doc_id", "g", rows, max_bytes, seed=1)])


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    network = docs.sparkSession.sparkContext.broadcast(network or train(docs))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        found = spans(common.texts(batch), network.value)
        base = [[s for s in x if s[2] != "model"] for x in found]
        count = {k: [sum(s[2] == k for s in x) for x in found] for k in KINDS}
        return {"doc_id": batch.column(0), "n_assign": count["assign"], "n_access": count["access"], "n_hex": count["hex"], "base_sha256": [common.sha256_hex(written(x)) for x in base], "spans": [written(x) for x in found], "n_model": count["model"]}

    return common.map_text(docs.select("doc_id", "text"), FOUND, work)
