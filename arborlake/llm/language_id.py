"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram binds its letters' vectors, each rotated by its place, by
elementwise product; a document bundles (adds up) its n-grams; a language bundles its documents. Documents are compared with
the languages' prototypes by cosine.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

#: Components of a vector, letters of an n-gram, distinct letter symbols (a-z, a gap, and hashed classes of other letters).
DIM, GRAM, SYMBOLS = 512, 3, 48
GAP = 26
#: Characters that are turned into n-grams at a time: bounds memory for long texts.
CHUNK = 1 << 20
#: Texts count as of no known language below this cosine. Less is asked of short ones, whose cosines are low by nature: the
#: share (n - FEW) / (n + SHORT) of it at n characters, and nothing up to FEW.
LEAST_COSINE, SHORT, FEW = 0.15, 200, 20
UNKNOWN = "und"
GUESS = "_language_guess"


def _symbol(code: int) -> int:
    """Symbol of a character: case is folded, all but letters are gaps."""
    if not chr(code).isalpha():
        return GAP
    low = ord(chr(code).lower()[0])
    return low - 97 if 97 <= low <= 122 else GAP + 1 + (low * 2654435761 % 2**32 >> 11) % (SYMBOLS - GAP - 1)


@lru_cache(1)
def _basic_plane() -> np.ndarray:
    return np.array([_symbol(c) for c in range(1 << 16)], dtype=np.int64)


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of characters, by code point, of all planes."""
    beyond = codes > 0xFFFF
    out = _basic_plane()[np.where(beyond, 0, codes)]
    if beyond.any():
        each, at = np.unique(codes[beyond], return_inverse=True)
        out[beyond] = np.array([_symbol(int(c)) for c in each], dtype=np.int64)[at]
    return out


@lru_cache(1)
def _gram_vectors() -> dict:
    """Letter vectors rotated by place, and a lazily filled table of n-gram vectors (at most SYMBOLS ** GRAM rows)."""
    letters = np.random.default_rng(20240229).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIM))
    rotated = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
    return {"rotated": rotated, "row": np.full(SYMBOLS**GRAM, -1, dtype=np.int32), "table": np.zeros((0, DIM), dtype=np.int8)}


def _vectors_of(grams: np.ndarray) -> np.ndarray:
    """Row numbers of the n-grams in the table of vectors, binding the ones that are new."""
    held = _gram_vectors()
    new = grams[held["row"][grams] < 0]
    if len(new):
        bound = np.ones((len(new), DIM), dtype=np.int8)
        for k, vectors in enumerate(held["rotated"]):
            bound *= vectors[new // SYMBOLS ** (GRAM - 1 - k) % SYMBOLS]
        held["row"][new] = len(held["table"]) + np.arange(len(new), dtype=np.int32)
        held["table"] = np.concatenate([held["table"], bound])
    return held["row"][grams]


def profile(text: str | None) -> np.ndarray | None:
    """The bundle of a text's n-grams, of unit length; None if it has no letter. Gaps between words count as one symbol."""
    if not text:
        return None
    total, lettered, carry = np.zeros(DIM, dtype=np.float64), False, np.array([GAP], dtype=np.int64)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = np.concatenate([carry, symbols(codes), *([[GAP]] if at + CHUNK >= len(text) else [])])
        s = s[np.concatenate([[True], (s[1:] != GAP) | (s[:-1] != GAP)])]
        lettered |= bool((s != GAP).any())
        if len(s) >= GRAM:
            grams = s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]
            grams, counts = np.unique(grams, return_counts=True)
            rows = _vectors_of(grams)
            total += counts.astype(np.float32) @ _gram_vectors()["table"][rows].astype(np.float32)
        carry = s[-2:]
    norm = np.linalg.norm(total)
    if not lettered or norm == 0:
        return None
    return total / norm


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototype of each non-null language: the bundle of all its documents' profiles.

    Each task adds up its own documents, so a language with any share of the rows sends one vector a task. Only the
    prototypes (one of DIM numbers for each language) reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                v = profile(text)
                if v is not None:
                    sums[lang] = sums[lang] + v if lang in sums else v
        yield pd.DataFrame([(k, i, float(x)) for k, v in sums.items() for i, x in enumerate(v)], columns=["lang", "i", "x"])

    known = in_small_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # Sums are rounded, so that the order in which tasks finish can't show in them.
    summed = known.mapInPandas(run, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["i"]] = round(r["x"], 6)
    return {k: v / (np.linalg.norm(v) or 1.0) for k, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the language of the highest cosine (ties: the first by name) and that cosine, 0 to 1.

    lang_pred is und, score 0, if the text is null or has no letter, or no language was learned.
    """
    names, matrix = list(prototypes), np.array(list(prototypes.values()))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            said, scores = [], []
            for text in texts:
                v = profile(text) if names else None
                if v is None:
                    said.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cosines = matrix @ v
                    k = int(np.argmax(np.round(cosines, 9)))
                    said.append(names[k])
                    scores.append(float(min(1.0, max(0.0, cosines[k]))))
            yield pd.DataFrame({"lang_pred": said, "score": scores})

    guess = F.pandas_udf(run, "lang_pred string, score double")
    held = GUESS
    while held in docs.columns:
        held += "_"
    return docs.withColumn(held, guess(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{held}.lang_pred").alias("lang_pred"), F.col(f"{held}.score").alias("score"))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3 (null: 0); 1 is held out from learning."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(3)), F.lit(0))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred and score of every document, learning only from those not held out.

    Whole texts are used; texts longer than CHUNK are read piece by piece. Repeated rows each get their row and weigh in the
    learning each; other columns are not returned. An empty table gives no rows.
    """
    prototypes = learn(docs.where(fold(id_col) != 1), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("_id"), (fold(id_col) == 1).alias("_held"), F.col(text_col).alias("_text"))
    return predict(rows, prototypes, "_text").select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, with all their columns, whose text is in one of the learned languages.

    Rejected are texts without a letter (or null), and those whose best cosine is below what is asked at their length: nothing up to FEW
    characters, and LEAST_COSINE in the end. Repeated rows are each judged; an empty table gives an empty one.
    """
    prototypes = learn(docs.where(fold(id_col) != 1), text_col, lang_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    n = F.length("text")
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_COSINE * F.greatest(n - FEW, F.lit(0)) / (n + SHORT))
    return predict(rows, prototypes, "text").where(known).select("row.*")
