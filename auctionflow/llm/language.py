"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and framed by spaces; its n-grams of ``ORDERS`` characters
are hashed to ``2**bits`` features.  Counts of a bounded sample of labelled rows
(``per_language`` rows of each language, ``max_bytes`` of text in all) give the
matrix of log-probabilities, which is broadcast; its size is 4 bytes x languages
x 2**bits, and ``bits`` gives way where that would be over ``MATRIX_BYTES`` (more
than 512 languages).  A batch is scored as a sum of the matrix rows of its n-grams.

The score is the posterior with evidence tempered to at most ``EVIDENCE`` n-grams,
so that it says how clear the text is rather than how long.  Null, empty and
letterless texts (no character of a Unicode letter category) are ``und`` with score 0; so are all texts if nothing was learned.  Ties
go to the language that sorts first.  Repeated rows give a row each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDERS, EVIDENCE, MATRIX_BYTES = (1, 2, 3), 60, 1 << 27
PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")  # letters, and digits and numbers that aren't decimal


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ngrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, text number of each) of all n-grams of the texts."""
    framed = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the end of the text
    found, of = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if n > len(codes):
                break
            h = h[: len(codes) - n + 1] * _A + (codes[n - 1 :] + np.uint64(n)) * _B
            if n in ORDERS:
                ok = left[: len(h)] >= n
                found.append(((h ^ (h >> np.uint64(29))) * _A >> np.uint64(64 - bits))[ok].astype(np.int64))
                of.append(owner[: len(h)][ok])
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(of) if of else np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray  # features x languages
    bits: int

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        with_letters = [i for i, t in enumerate(texts) if has_letter(t)]
        if not with_letters or not self.languages:
            return names, scores
        feature, owner = ngrams([texts[i] for i in with_letters], self.bits)
        total = np.stack([np.bincount(owner, weights=self.logp[:, c][feature], minlength=len(with_letters)) for c in range(len(self.languages))], axis=1)
        n = np.bincount(owner, minlength=len(with_letters))
        best = (total + self.prior).argmax(axis=1)
        tempered = total * np.minimum(1.0, EVIDENCE / n)[:, None] + self.prior
        tempered = np.exp(tempered - tempered.max(axis=1, keepdims=True))
        share = tempered / tempered.sum(axis=1, keepdims=True)
        for k, i in enumerate(with_letters):
            names[i], scores[i] = self.languages[best[k]], float(share[k, best[k]])
        return names, scores


def fit(labelled: list[tuple[str, str]], counts: dict[str, int] | None = None, bits: int = 16, alpha: float = 0.1) -> Model:
    """From (text, language) pairs; ``counts``: rows of each language in the whole table, for the priors."""
    languages = sorted({lang for _, lang in labelled})
    while len(languages) * 4 << bits > MATRIX_BYTES:
        bits -= 1
    logp = np.zeros((1 << bits, len(languages)), np.float64)
    prior = np.zeros(len(languages))
    for c, lang in enumerate(languages):
        own = [t for t, x in labelled if x == lang]
        seen = np.full(1 << bits, alpha)
        for a in range(0, len(own), 200):
            seen += np.bincount(ngrams(own[a : a + 200], bits)[0], minlength=1 << bits)
        logp[:, c] = np.log(seen / seen.sum())
        prior[c] = np.log((counts or {}).get(lang, len(own)) or 1)
    return Model(languages, prior - (np.logaddexp.reduce(prior) if len(prior) else 0), logp.astype(np.float32), bits)


def identify(docs: DataFrame, per_language: int = 1500, max_bytes: int = 16_000_000) -> DataFrame:
    """Learns from the rows that are not held out, and predicts all."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(common.id_text_crc("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    known = docs.where(~held_out & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    sample = common.bounded_sample(known, "doc_id", "lang", per_language, max_bytes, seed=6)
    model = spark.sparkContext.broadcast(fit([(r["text"], r["lang"]) for r in sample], counts))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        names, scores = model.value.predict(common.texts(batch))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": names, "score": scores}

    return common.map_text(docs.select("doc_id", "text", held_out), PREDICTED, work)
