"""Language identification by compression.

Each language gets a raw-content zstandard dictionary of sampled texts. A text is compressed whole, as words of lower-case
letters in windows, with every dictionary; the language whose dictionary leaves the fewest bytes over all windows is chosen,
and the answer is rejected when the margin is narrow. Each window starts from the dictionary alone, so the margin does not
fade with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import join_sized, row_runs, stage, texts_of

#: Bytes of dictionary for each language; the bounded sample that the classifier is fitted on.
DICTIONARY_BYTES = 112 << 10
#: Bytes of all dictionaries together; with more languages than fill it each gets an equal share, so none is left out.
ALL_BYTES = 32 << 20
#: Bytes of folded text that are compressed together.
WINDOW = 8192
#: Texts sampled for each language, or more while they fill no dictionary; they are joined, shortest first, until it is full.
SAMPLE_TEXTS = 400
#: Code points of a sampled text that may go into the dictionary, from its first letter on.
TEXT_CHARS = 20_000
LEVEL, MARGIN = 6, 0.002
UNKNOWN = "und"
#: A letter, in learning and predicting: Unicode's category L.
LETTER = r"\p{L}"
_LETTER = regex.compile(LETTER)
#: ASCII letters and what is beyond ASCII stay, all else is a space.
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str) -> bytes:
    """Lower-case words of letters, a space between."""
    return b" ".join(text.lower().encode().translate(_KEEP).split())


def dictionaries(
    df: DataFrame, learn: Column, text_col: str, lang_col: str, size: int = DICTIONARY_BYTES, texts: int = SAMPLE_TEXTS, chars: int = TEXT_CHARS,
    total: int = ALL_BYTES,
) -> dict[str, bytes]:
    """Sampled text of each language that has a text with a letter, the one with most such texts first; at most ``size`` bytes
    each and ``total`` bytes together.

    Texts of any length are drawn by the smallest hashes of distinct texts: ``texts`` of them, or as many as fill ``size``
    bytes if that is more. Of a text ``chars`` code points from its first letter on are taken. The sample is drawn through a threshold
    on the hash, so that no task and not the driver gets a language's rows; the driver sees one count a language and the
    dictionaries.
    """
    known = df.select(
        F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("g"), learn.alias("ok"),
    ).filter(F.col("ok") & F.col("g").isNotNull() & F.col("t").rlike(LETTER))
    lettered = F.regexp_replace("t", r"^\P{L}+", "")
    hashed = known.select("g", F.shiftrightunsigned(F.xxhash64("t"), 1).alias("h"), F.substring(lettered, 1, chars).alias("t"))
    counts = stage(hashed.groupBy("g").agg(F.approx_count_distinct("h").alias("n"), F.avg(F.octet_length("t") + 1).alias("b")), "languages")
    number = counts.count()
    if not number:
        return {}
    size = max(1, min(size, total // number))
    share = F.least(F.lit(1.0), 2.0 * F.greatest(F.lit(float(texts)), F.lit(float(size)) / F.col("b")) / F.col("n"))
    near = join_sized(hashed, counts.select("g", (share * 2.0**63).alias("bound")), ["g"], "inner")
    near = near.filter(F.col("h") <= F.col("bound")).groupBy("g", "h").agg(F.min("t").alias("t"))
    before = lambda *by: F.coalesce(
        F.sum(F.octet_length("t") + 1).over(Window.partitionBy("g").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0),
    )
    nth = F.row_number().over(Window.partitionBy("g").orderBy("h"))
    drawn = near.withColumn("n", nth).withColumn("drawn", before("h")).filter((F.col("n") <= texts) | (F.col("drawn") < size))
    some = drawn.withColumn("at", before(F.length("t"), "h")).filter(F.col("at") < size).groupBy("g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(-F.length("t"), "h", "t"))), lambda x: F.substring(x["t"], 1, size)).alias("d")
    )
    content = {r["g"]: b"\n".join(map(fold, r["d"]))[-size:] for r in some.collect()}
    order = [r["g"] for r in counts.orderBy(F.desc("n"), "g").select("g").collect()]
    return {g: content[g] for g in order if g in content}


def windows(folded: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The whole text in parts of about ``size`` bytes that end between words; an end shorter than half joins the part before."""
    at = 0
    while len(folded) - at > size + size // 2:
        stop = folded.rfind(b" ", at + 1, at + size)
        stop = at + size if stop < 0 else stop
        yield folded[at:stop]
        at = stop
    yield folded[at:]


def identify(texts: list[bytes], compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> list[tuple[str, float, float]]:
    """(language, score, margin) of each text; margin: how many of its compressed bytes the best saves against the second."""
    out = []
    for text in texts:
        whole = text.decode("utf-8", "replace")
        if not compressors or not _LETTER.search(whole):
            out.append((UNKNOWN, 0.0, 0.0))
            continue
        folded = fold(whole)
        parts = list(windows(folded))
        sizes = sorted((sum(len(c.compress(part)) for part in parts), i) for i, (_, c) in enumerate(compressors))
        best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else len(folded) + 16 * len(parts)
        margin = (second - best) / max(second, 1)
        out.append((compressors[sizes[0][1]][0], 1 - 0.5 * (1 - min(1.0, max(0.0, margin))) ** 8, margin))
    return out


def identify_languages(
    df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN, level: int = LEVEL,
) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` of each row.

    Languages are the non-null values of ``lang_col`` where ``learn`` holds and the text, of any length, has a letter.
    A letter is what Unicode has in its category L, so ``²``, ``½`` and ``Ⅷ`` are none.
    ``lang_pred`` is the best guess, ``rejected`` says that its margin over the second best is below ``margin``. A null text
    or one without a letter is ``und`` with score 0 and rejected; ties go to the language with most texts. Repeated rows come
    out as often as they come in; other columns are not read; with nothing to learn from all is ``und``; an empty table gives
    no rows.
    """
    found = df.sparkSession.sparkContext.broadcast(dictionaries(df, learn, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = []
        for g, content in found.value.items():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=level)
            compressors.append((g, zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_dict_id=False)))
        for batch in batches:
            for part in row_runs(batch, "_text"):
                got = identify(texts_of(part.column("_text")), compressors)
                cols = [
                    pa.array([g for g, _, _ in got], pa.string()), pa.array([s for _, s, _ in got], pa.float64()),
                    pa.array([m for _, _, m in got], pa.float64()), pa.array([m < margin for _, _, m in got]),
                ]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *cols], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    schema = T.StructType(
        [
            T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
            T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
        ]
    )
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
