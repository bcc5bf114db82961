"""Small inputs with awkward rows, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)

Row = tuple[int | None, str | None, str | None, str | None, int | None]


def rows(seed: int = 1, n: int = 60) -> list[Row]:
    """Prose with shared passages, copies, near copies, one long text, empty and null texts."""
    rng = random.Random(seed)
    words = {
        "en": ["the", "of", "water", "stone,", "light", "and", "house.", "river", "walking", "thing"],
        "fr": ["le", "de", "eau", "pierre,", "lumière", "et", "maison.", "rivière", "été", "chose"],
    }
    passage = " ".join(f"shared{i}" for i in range(70))
    out: list[Row] = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        body = [f"{rng.choice(words[lang])}{rng.choice(['', '', str(rng.randrange(9))])}" for _ in range(rng.randrange(1, 180))]
        text = " ".join(body)
        if i % 5 == 0:
            text = text[: len(text) // 2] + " " + passage + "\n" + text[len(text) // 2 :]
        out.append((i, text, lang if i % 7 else None, f"src{i % 4}" if i % 11 else None, len(text)))
    out[7] = (7, out[3][1], "fr", "src0", 1)
    out[8] = (8, (out[3][1] or "") + " more", "fr", "src0", 1)
    out[9] = (9, None, None, None, None)
    out[10] = (10, "", "en", "src1", 0)
    out[11] = (11, " \n\t ", "fr", "src1", 3)
    out[12] = (12, "é" * 90 + " 12 %% \n12 %%\n", "fr", "src2", 90)
    out[13] = (13, " ".join(["again and"] * 900), "en", "src0", 9000)
    out.append(out[14])  # a repeated row
    return out


def frame(spark: SparkSession, data: list[Row], parts: int = 3) -> DataFrame:
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def repeats(data: list[Row], as_bytes: bool) -> dict[int, tuple[int, int, int, str]]:
    """Units, removed units, runs and digest of what stays, for every id."""
    seen: set[object] = set()
    out = {}
    for d, text in sorted({(r[0], r[1]) for r in data if r[0] is not None}, key=lambda r: r[0]):
        units = (text or "").encode() if as_bytes else [w.encode() for w in words(text)]
        windows = [bytes(units[i : i + 50]) if as_bytes else tuple(units[i : i + 50]) for i in range(len(units) - 49)]
        gone = bytearray(len(units))
        for i, w in enumerate(windows):
            if w in seen:
                gone[i : i + 50] = b"\1" * 50
        seen.update(windows)
        kept = bytes(u for u, g in zip(units, gone, strict=True) if not g) if as_bytes else b" ".join(u for u, g in zip(units, gone, strict=True) if not g)
        out[d] = (len(units), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(text: str | None) -> int:
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
