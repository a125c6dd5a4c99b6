"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte n-grams of the letters (1 to 4 bytes of UTF-8). One
linear scorer per family (squared hinge, one against the rest) picks the
family; inside a family one linear support vector machine per pair of languages
votes. Families: a table of common codes; a code outside it joins the family
whose centroid is most similar.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import arrow_texts, fold, pieces, saved, sigmoid

ROWS_PER_LANGUAGE = 900
BUCKETS = 4096

# Families of common language codes.
FAMILIES = {
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "ne", "gu", "pa"),
    "semitic": ("ar", "he", "mt", "am"),
    "cjk": ("zh", "ja", "ko"),
}

_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)
_LETTER[128:] = np.arange(27, 155)


@dataclass(frozen=True)
class LanguageModel:
    families: tuple[tuple[str, ...], ...]
    family_weights: np.ndarray  # (BUCKETS + 1) x families
    pairs: tuple[tuple[str, str], ...]
    pair_weights: np.ndarray  # (BUCKETS + 1) x pairs; positive: the first


def features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit-length square roots of hashed n-gram counts, one row per text, and a constant 1."""
    n = len(at) - 1
    code = _LETTER[buf]
    doc = np.repeat(np.arange(n), np.diff(at))
    total = np.zeros(n * BUCKETS)
    key = np.zeros(len(buf), np.int64)
    for order in range(1, 5):
        if len(buf) < order:
            break
        key = key[: len(buf) - order + 1] * 160 + code[order - 1 :]
        inside = doc[: len(key)] == doc[order - 1 :]
        inside &= code[: len(key)] + code[order - 1 :] > 0  # not between blanks only
        spread = (key[inside] * 0x9E3779B1 + order * 0x85EBCA6B) & 0xFFFFFFFFFFFF
        total += np.bincount(doc[: len(key)][inside] * BUCKETS + (spread >> 20) % BUCKETS, minlength=n * BUCKETS)
    out = np.ones((n, BUCKETS + 1), np.float32)
    rows = np.sqrt(total.reshape(n, BUCKETS)).astype(np.float32)
    out[:, :BUCKETS] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights for labels +1 / -1: squared hinge and ridge, by accelerated gradient steps.

    Both classes carry the same total weight.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 1.0 / (1.0 + 4 * cost)  # the rows have length sqrt(2)
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        slope = ahead - 2 * cost * (x.T @ (share * y * slack))
        new = ahead - rate * slope
        ahead, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


def fit(sample: list[tuple[str, str]]) -> LanguageModel:
    """Family scorers and pair machines from (text, language) rows."""
    known = sorted({lang for _, lang in sample})
    if not known:
        return LanguageModel((), np.zeros((BUCKETS + 1, 0), np.float32), (), np.zeros((BUCKETS + 1, 0), np.float32))
    x = np.concatenate([features(buf, at) for _, buf, at in pieces(arrow_texts([t for t, _ in sample]))])
    lang = np.array([c for _, c in sample])
    centroid = {c: x[lang == c].mean(axis=0) for c in known}
    groups: dict[str, list[str]] = {}
    for c in known:
        family = next((f for f, codes in FAMILIES.items() if c.lower().split("-")[0] in codes), None)
        if family:
            groups.setdefault(family, []).append(c)
    for c in known:
        if not any(c in g for g in groups.values()):
            like = max(
                ((float(centroid[c] @ centroid[o]), f) for f, g in groups.items() for o in g), default=(0.0, c)
            )
            groups.setdefault(like[1], []).append(c)
    families = tuple(tuple(sorted(g)) for _, g in sorted(groups.items()))
    member = np.array([next(i for i, g in enumerate(families) if c in g) for c in lang])
    family = [linear_svm(x, np.where(member == i, 1, -1).astype(np.float32)) for i in range(len(families))]
    pairs = tuple(p for g in families for p in combinations(g, 2))
    machines = []
    for a, b in pairs:
        two = (lang == a) | (lang == b)
        machines.append(linear_svm(x[two], np.where(lang[two] == a, 1, -1).astype(np.float32)))
    shape = (BUCKETS + 1, 0)
    return LanguageModel(
        families, np.column_stack(family) if len(families) > 1 else np.zeros((BUCKETS + 1, 1), np.float32), pairs,
        np.column_stack(machines) if pairs else np.zeros(shape, np.float32),
    )


def predict(model: LanguageModel, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    margins = 3 * (x @ model.family_weights)
    odds = np.exp(margins - margins.max(axis=1, keepdims=True))
    odds /= odds.sum(axis=1, keepdims=True)
    family = odds.argmax(axis=1)
    duel = x @ model.pair_weights
    out, score = [], np.zeros(len(x))
    at = {p: i for i, p in enumerate(model.pairs)}
    for r, f in enumerate(family.tolist()):
        codes = model.families[f]
        votes, sure = dict.fromkeys(codes, 0), dict.fromkeys(codes, 0.0)
        for p in combinations(codes, 2):
            m = float(duel[r, at[p]])
            votes[p[0] if m > 0 else p[1]] += 1
            sure[p[0]] += m
            sure[p[1]] -= m
        best = max(codes, key=lambda c: (votes[c], sure[c], c))
        chance = 1.0
        for p in combinations(codes, 2):
            if best in p:
                m = float(duel[r, at[p]])
                chance = min(chance, float(sigmoid(np.array(3 * (m if p[0] == best else -m)))))
        out.append(best)
        score[r] = odds[r, f] * chance
    return out, score


def sample_rows(docs: DataFrame, modulus: int, held: int, per_language: int) -> list[tuple[str, str]]:
    """(text, lang) of about `per_language` documents of every language outside the held-out fold.

    Chosen by a seeded hash with a rate per language from counts over all ids.
    """
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held)
    ).distinct()
    rates = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = saved(known.join(rates, "lang").filter(draw < F.col("rate")).select("doc_id", "lang").distinct(), "languages")
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    # one text for each id, however many rows repeat it
    rows = rows.groupBy("doc_id", "lang").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = rows.orderBy("doc_id", "lang").select("text", "lang").toArrow()
    return list(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def identify(docs: DataFrame, modulus: int = 3, held: int = 1, per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs(doc_id, text, lang).

    Learns from text and non-null lang of about `per_language` documents of each
    language with crc32(doc_id) mod modulus <> held. A null text and a text
    without a letter give `und` with score 0, as does every text when nothing
    was learned. Whole texts are read. Repeated rows stay repeated; other
    columns are ignored; a null doc_id has held_out null.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang"
    )
    model = fit(sample_rows(docs, modulus, held, per_language))

    def run(batches):
        for batch in batches:
            for part, buf, at in pieces(batch):
                letters = np.diff(np.concatenate([[0], np.cumsum(_LETTER[buf] > 0)])[at])
                plain = np.diff(np.concatenate([[0], np.cumsum((_LETTER[buf] > 0) & (buf < 128))])[at])
                some = plain > 0
                for i in np.flatnonzero((letters > 0) & ~some):
                    some[i] = any(map(str.isalpha, buf[at[i] : at[i + 1]].tobytes().decode()))
                if model.families:
                    found, score = predict(model, features(buf, at))
                    found = [c if ok else "und" for c, ok in zip(found, some)]
                else:
                    found, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.string()), pa.array(np.where(some, score, 0.0))],
                    names=["doc_id", "lang_pred", "score"],
                )

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score")
