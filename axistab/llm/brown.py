"""Brown class-based bigram scoring.

Exchange clustering gives every word of the training texts one of ``classes`` classes. A text's probability is the product
of class transitions and word emissions: P(w | h) = (1 - P(unknown | h)) * P(class(w) | class(h)) * count(w) / count(class).
Transitions are smoothed towards the classes' own frequencies; the unknown word follows a class as often as words seen once.

The corpus is staged once as blocks of word numbers. Frequent words (a bounded number, by a bound on their share) are
exchanged in several sweeps, with their classes broadcast. Every word meets its counts and contexts from all blocks in the
task of its hash range, where the other words are exchanged once, and the answers go back to the blocks that asked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import row_runs, stage, texts_of

CLASSES, SWEEPS = 62, 4
#: A word is frequent if it makes up 1 / FREQUENT of the training tokens; there are at most 2 FREQUENT such words.
FREQUENT = 32768
BLOCK_BYTES, SLICE = 4 << 20, 2048
BACKOFF, BACKOFF_UNKNOWN = 20.0, 50.0
_END, _UNKNOWN, _ONCE = b"", 255, 128


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def _unpack(blob: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return raw if kind is None else np.frombuffer(raw, kind)


def _block(ids: list[pa.Array], tokens: list[np.ndarray], lens: list[int], held: list[bool], words: dict[bytes, int], number: int) -> pa.RecordBatch:
    names = list(words)
    crc = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))
    order = np.argsort(crc, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    stream = place[np.concatenate(tokens)]
    all_ids = pa.concat_arrays(ids)
    train = int(sum(n for n, h in zip(lens, held, strict=True) if not h))
    cols = [
        pa.array([(TaskContext.get().partitionId() << 24) + number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
        *(pa.array([_pack(x)], pa.binary()) for x in (np.array(lens, np.int32), np.array(held, np.uint8), b" ".join(names[i] for i in order), crc[order], stream)), pa.array([train], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "lens", "held", "words", "crcs", "stream", "train"])


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, tokens, lens, held, words, size, number = [], [], [], [], {}, 0, 0
    for batch in batches:
        for part in row_runs(batch, "_text", BLOCK_BYTES // 4):
            ids.append(part.column("_id"))
            held += part.column("_held").to_pylist()
            for text in texts_of(part.column("_text")):
                line = text.lower().split()
                line.append(_END)
                tokens.append(np.array([words.setdefault(w, len(words)) for w in line], np.int64))
                lens.append(len(line))
                size += len(text) + 1
            if size >= BLOCK_BYTES:
                yield _block(ids, tokens, lens, held, words, number)
                ids, tokens, lens, held, words, size, number = [], [], [], [], {}, 0, number + 1
    if lens:
        yield _block(ids, tokens, lens, held, words, number)


def word_blocks(df: DataFrame, held: Column, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType
    fields = [
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
        *(T.StructField(n, T.BinaryType()) for n in ("lens", "held", "words", "crcs", "stream")), T.StructField("train", T.LongType()),
    ]
    return stage(
        df.select(
            F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), held.alias("_held"),
        ).mapInArrow(_to_blocks, T.StructType(fields)),
        "blocks",
    )


def _read(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of a block, its stream of word numbers and which places of the stream are training text."""
    lens, held = _unpack(row["lens"], np.int32), _unpack(row["held"], np.uint8)
    return _unpack(row["words"]).split(b" "), _unpack(row["stream"], np.uint32).astype(np.int64), np.repeat(held == 0, lens)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def frequent_words(blocks: DataFrame, total: int, frequent: int = FREQUENT) -> list[bytes]:
    """The end first, then words by falling count: every word with 1 / ``frequent`` of the tokens, 2 ``frequent`` at most.

    Blocks report the words with half that share of their own tokens, so the summed counts fall short by half of it at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, stream, train = _read(row)
            count = np.bincount(stream[train], minlength=len(words))
            some = np.flatnonzero((count > 0) & (count * 2 * frequent >= row["train"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in some], pa.binary()), pa.array(count[some], pa.int64())], names=["word", "n"],
            )

    seen = blocks.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") * 2 * frequent >= total)
    return [_END, *(bytes(r["word"]) for r in seen.orderBy(F.desc("n"), "word").collect() if bytes(r["word"]) != _END)]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(right: np.ndarray, left: np.ndarray, own: np.ndarray, matrix: np.ndarray, classes: int) -> np.ndarray:
    """The class that raises the class-bigram likelihood most for each word, others staying where they are.

    ``right``, ``left``: counts of the classes after and before each word; ``own``: its class now; ``matrix``: class bigrams.
    """
    out = own.copy()
    rows, cols = matrix.sum(axis=1), matrix.sum(axis=0)
    for i in range(len(own)):
        r, l, a = right[i], left[i], own[i]  # noqa: E741
        if not r.any() and not l.any():
            continue
        n = matrix.copy()
        n[a] -= r
        n[:, a] -= l
        np.maximum(n, 0, out=n)
        before, after = rows.copy(), cols.copy()
        before[a] -= r.sum()
        after[a] -= l.sum()
        j, k = np.flatnonzero(r), np.flatnonzero(l)
        gain = (_xlogx(n[:classes, j] + r[j]) - _xlogx(n[:classes, j])).sum(axis=1) + (
            _xlogx(n[k, :classes].T + l[k]) - _xlogx(n[k, :classes].T)
        ).sum(axis=1)
        # Where a class follows itself both add to one count.
        own_next, r_own, l_own = n.diagonal()[:classes], r[:classes], l[:classes]
        gain += _xlogx(own_next + r_own + l_own) - _xlogx(own_next + r_own) - _xlogx(own_next + l_own) + _xlogx(own_next)
        gain -= _xlogx(before[:classes] + r.sum()) - _xlogx(before[:classes]) + _xlogx(after[:classes] + l.sum()) - _xlogx(after[:classes])
        out[i] = int(np.argmax(gain))
    return out


def _contexts(index, now, classes: int):
    """Class contexts of frequent words and class bigrams, summed over the blocks of a task."""
    width = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums = len(now.value), None
        for row in _rows(batches):
            words, stream, train = _read(row)
            get = index.value.get
            head = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            kind = np.where(head >= 0, now.value[np.maximum(head, 0)], classes).astype(np.int64)
            cur = stream[train]
            if sums is None:
                sums = [np.zeros(number * width, np.int64), np.zeros(number * width, np.int64), np.zeros(width * width, np.int64)]
            if not len(cur):
                continue
            ch, ck = head[cur], kind[cur]
            ph, pk = np.r_[0, ch[:-1]], np.r_[classes + 1, ck[:-1]]
            sums[2] += np.bincount(pk * width + ck, minlength=width * width)
            sums[0] += np.bincount((ph * width + ck)[ph >= 0], minlength=number * width)
            sums[1] += np.bincount((ch * width + pk)[ch >= 0], minlength=number * width)
        if sums is not None:
            salt = TaskContext.get().partitionId() % 64
            step = SLICE * width
            rows = [(-1, salt, _pack(sums[2]), _pack(sums[2]))] + [
                (i, salt, _pack(sums[0][i * step : (i + 1) * step]), _pack(sums[1][i * step : (i + 1) * step])) for i in range(-(-number // SLICE))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["slice", "salt", "r", "l"],
            )

    return run


def _moves(now, matrix: np.ndarray, sweep: int, classes: int):
    """The exchange of a slice of frequent words: those not placed yet in sweep 0, every second one after."""
    width = classes + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["slice"].iloc[0])
        before = now.value[at * SLICE : (at + 1) * SLICE]
        right, left = (_unpack(pdf[c].iloc[0], np.int64).reshape(-1, width).astype(float) for c in ("r", "l"))
        turn = np.arange(len(before)) % 2 == sweep % 2 if sweep else before == classes
        turn &= before != classes + 1
        after = before.copy()
        after[turn] = exchange(right[turn], left[turn], before[turn], matrix, classes)
        return pd.DataFrame({"slice": [at], "own": [after.tobytes()]})

    return run


def cluster_frequent(blocks: DataFrame, heads: list[bytes], classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each frequent word, and the class bigrams of the last sweep.

    Class ``classes`` holds all words not placed yet, the one after it the end. The most frequent words start in a class each;
    a first sweep places all others, the next ones exchange every second word in turn.
    """
    spark, width = blocks.sparkSession, classes + 2
    index = spark.sparkContext.broadcast({w: i for i, w in enumerate(heads)})
    own = np.full(len(heads), classes, np.uint8)
    own[1 : classes + 1] = np.arange(min(classes, len(heads) - 1))
    own[0] = classes + 1
    matrix = np.zeros((width, width))

    def summed(slices: DataFrame, *keys: str) -> DataFrame:
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            both = [np.sum([_unpack(b, np.int64) for b in pdf[c]], axis=0) for c in ("r", "l")]
            return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "r": [_pack(both[0])], "l": [_pack(both[1])]})

        return slices.groupBy(*keys).applyInPandas(add, "slice int, salt int, r binary, l binary")

    for sweep in range(sweeps + 1):
        now = spark.sparkContext.broadcast(own)

        counted = blocks.select("lens", "held", "words", "stream").mapInArrow(
            _contexts(index, now, classes), "slice int, salt int, r binary, l binary",
        )
        table = stage(summed(summed(counted, "slice", "salt"), "slice"), "contexts")
        found = table.filter("slice = -1").first()
        if found is None:
            break
        matrix = _unpack(bytes(found["r"]), np.int64).reshape(width, width).astype(float)
        if sweep == sweeps:
            break

        moved = table.filter("slice >= 0").groupBy("slice").applyInPandas(
            _moves(now, matrix, sweep, classes), "slice int, own binary",
        ).orderBy("slice").collect()
        own = np.frombuffer(b"".join(bytes(r["own"]) for r in moved), np.uint8)
    return own, matrix


def _asked(parts: int, index, now, classes: int):
    """Messages from blocks to hash ranges: words, training counts and, for words that are not frequent, class contexts."""
    width = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, stream, train = _read(row)
            crc = _unpack(row["crcs"], np.uint32)
            get = index.value.get
            head = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            kind = np.where(head >= 0, now.value[np.maximum(head, 0)], classes).astype(np.int64)
            cur = stream[train]
            count = np.bincount(cur, minlength=len(words))
            before = np.r_[classes + 1, kind[cur[:-1]]] if len(cur) else cur
            tail = head[cur] < 0
            after_ok = tail[:-1] if len(cur) else tail
            keys = np.concatenate([(cur[:-1] * 2 * width + kind[cur[1:]])[after_ok], (cur * 2 * width + width + before)[tail]]) if len(cur) else cur
            keys, n = np.unique(keys, return_counts=True)
            word = keys // (2 * width)
            part = (crc.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            ends = np.searchsorted(word, cuts)
            rows = []
            for p in range(parts):
                lo, hi, a, b = cuts[p], cuts[p + 1], ends[p], ends[p + 1]
                if hi > lo:
                    rows.append(
                        (
                            p, row["block"], _pack(b" ".join(words[lo:hi])), _pack(count[lo:hi].astype(np.int64)),
                            _pack((word[a:b] - lo).astype(np.int32)), _pack((keys[a:b] % (2 * width)).astype(np.uint8)),
                            _pack(n[a:b].astype(np.int64)),
                        )
                    )
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=["part", "block", "words", "counts", "word", "code", "n"],
            )

    return run


def _answered(index, now, matrix: np.ndarray, classes: int):
    """Sums a hash range's messages, exchanges its words and answers each block in the order of its question."""
    width = classes + 2
    base = np.concatenate([matrix[:classes, :].T, matrix[:, :classes]])  # contexts after, then before, by class to join
    once = _xlogx(base + 1) - _xlogx(base)
    rows_sum, cols_sum = matrix.sum(axis=1)[:classes], matrix.sum(axis=0)[:classes]

    def run(table: pa.Table) -> pa.Table:
        words: dict[bytes, int] = {}
        blocks, places, keys, sums = [], [], [], []
        total = np.zeros(0, np.int64)
        for row in _rows(table.to_batches(max_chunksize=1)):
            mine = np.fromiter((words.setdefault(w, len(words)) for w in _unpack(row["words"]).split(b" ")), np.int64)
            if len(words) > len(total):
                total = np.r_[total, np.zeros(max(len(words) - len(total), len(total)), np.int64)]
            total[mine] += _unpack(row["counts"], np.int64)
            keys.append(mine[_unpack(row["word"], np.int32)] * (2 * width) + _unpack(row["code"], np.uint8))
            sums.append(_unpack(row["n"], np.int64))
            blocks.append(row["block"])
            places.append(mine)
        total = total[: len(words)]
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(sums)).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        kind = np.full(len(words), classes - 1, np.uint8)
        owner, code = key // (2 * width), key % (2 * width)
        firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(key) else np.zeros(0, np.int64)
        for lo in range(0, len(firsts), 4000):
            some = firsts[lo : lo + 4000]
            stop = firsts[lo + 4000] if lo + 4000 < len(firsts) else len(key)
            c, m = code[some[0] : stop], n[some[0] : stop]
            gain = once[c]
            more = m > 1
            gain[more] = _xlogx(base[c[more]] + m[more, None]) - _xlogx(base[c[more]])
            cuts = some - some[0]
            gain = np.add.reduceat(gain, cuts, axis=0)
            for side, whole in ((c < width, rows_sum), (c >= width, cols_sum)):
                s = np.add.reduceat(np.where(side, m, 0), cuts)[:, None]
                gain -= _xlogx(whole + s) - _xlogx(whole)[None, :]
            # Where a class follows itself both sides add to one count.
            nth = np.repeat(np.arange(len(some)), np.diff(np.r_[cuts, len(c)]))
            after, behind = c < classes, (c >= width) & (c < width + classes)
            both, i, j = np.intersect1d(nth[after] * width + c[after], nth[behind] * width + c[behind] - width, assume_unique=True, return_indices=True)
            if len(both):
                r, l, d = m[after][i], m[behind][j], matrix.diagonal()[both % width]  # noqa: E741
                gain[both // width, both % width] += _xlogx(d + r + l) - _xlogx(d + r) - _xlogx(d + l) + _xlogx(d)
            kind[owner[some]] = np.argmax(gain, axis=1)
        get = index.value.get
        for w, i in words.items():
            h = get(w)
            if h is not None:
                kind[i] = now.value[h]
        kind[total == 0] = _UNKNOWN
        known = total > 0
        stats = np.r_[np.bincount(kind[known], weights=total[known], minlength=width), total.sum(), known.sum(), (total == 1).sum()].astype(np.int64)
        part = table.column("part")[0].as_py()
        out = {
            "part": [part] * (len(blocks) + 1), "block": [*blocks, -1], "counts": [*(_pack(total[x]) for x in places), None],
            "kinds": [*(_pack(kind[x]) for x in places), None], "stats": [*[None] * len(blocks), stats.tolist()],
        }
        return pa.table(
            out,
            schema=pa.schema(
                [("part", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("kinds", pa.binary()), ("stats", pa.list_(pa.int64()))]
            ),
        )

    return run


def _classed(stats: np.ndarray, classes: int):
    """A block with its answers: class of each place, and each document's counts, base score and emission score."""
    width = classes + 2
    tokens, (n, v, _) = stats[:width].astype(float), stats[width:]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = next(_rows(left.to_batches()))
        answers = sorted(zip(right.column("part").to_pylist(), right.column("counts").to_pylist(), right.column("kinds").to_pylist(), strict=True))
        count = np.concatenate([_unpack(a[1], np.int64) for a in answers])
        kind = np.concatenate([_unpack(a[2], np.uint8) for a in answers])
        lens, stream = _unpack(row["lens"], np.int32), _unpack(row["stream"], np.uint32).astype(np.int64)
        known = count > 0
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        emitted = np.zeros(len(count))
        emitted[known] = np.log10(count[known] / tokens[kind[known]])
        marked = np.where(count == 1, kind | _ONCE, kind).astype(np.uint8)
        firsts = np.r_[0, np.cumsum(lens)[:-1]]
        per = [np.add.reduceat(x[stream], firsts) for x in (base, emitted, known.astype(np.int64))]
        out = {
            "ids": left.column("ids").combine_chunks(), "lens": [row["lens"]], "held": [row["held"]], "kinds": [_pack(marked[stream])],
            "base": [per[0].tolist()], "emitted": [per[1].tolist()], "known": [per[2].tolist()],
        }
        return pa.table(out)

    return run


def _transitions(classes: int):
    width = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * (width + 1), np.int64)
        for row in _rows(batches):
            lens, held, kinds = _unpack(row["lens"], np.int32), _unpack(row["held"], np.uint8), _unpack(row["kinds"], np.uint8)
            cur = kinds[np.repeat(held == 0, lens)]
            if len(cur):
                kind = (cur & 127).astype(np.int64)
                before = np.r_[classes + 1, kind[:-1]]
                sums += np.bincount(before * (width + 1) + kind, minlength=len(sums))
                sums += np.bincount(before[cur >= _ONCE] * (width + 1) + width, minlength=len(sums))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], names=["i", "n"])

    return run


def _scores(step: np.ndarray, unknown: np.ndarray, classes: int, total: int, kind_of_id: pa.DataType | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("lens", "held", "kinds", "base", "emitted", "known")}
                lens, held, kinds = _unpack(row["lens"], np.int32), _unpack(row["held"], np.uint8), _unpack(row["kinds"], np.uint8)
                known = kinds != _UNKNOWN
                kind = np.where(known, kinds & 127, 0).astype(np.int64)
                last = np.maximum.accumulate(np.where(known, np.arange(len(kinds)), -1))
                last = np.r_[-1, last[:-1]]
                before = np.where(last >= 0, kind[np.maximum(last, 0)], classes + 1)
                each = np.where(known, step[before, kind], unknown[before])
                score = np.add.reduceat(each, np.r_[0, np.cumsum(lens)[:-1]]) + np.array(row["emitted"])
                ids = batch.column("ids").slice(i, 1).flatten()
                cols = [
                    ids, pa.array(held.astype(bool)), pa.array(lens.astype(np.int64)), pa.array(row["known"], pa.int64()),
                    pa.array(np.full(len(lens), total, np.int64)), pa.array(row["base"], pa.float64()), pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _fitted(
    df: DataFrame, held: Column, id_col: str, text_col: str, classes: int, sweeps: int, frequent: int,
) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """Blocks, the answers to them (count and class of each word of each block), the statistics of classes, and the number of
    groups to deal blocks to."""
    if not 1 <= classes <= 120:
        raise ValueError("classes must be from 1 to 120")
    spark, width = df.sparkSession, classes + 2
    blocks = word_blocks(df, held, id_col, text_col)
    whole = blocks.agg(F.sum("train").alias("n"), F.count(F.lit(1)).alias("blocks")).first()
    heads = frequent_words(blocks, whole["n"] or 0, frequent)
    own, matrix = cluster_frequent(blocks, heads, classes, sweeps)
    index, now = spark.sparkContext.broadcast({w: i for i, w in enumerate(heads)}), spark.sparkContext.broadcast(own)
    parts = max(8, whole["blocks"] // 2)
    asked = blocks.select("block", "lens", "held", "words", "crcs", "stream").mapInArrow(
        _asked(parts, index, now, classes), "part int, block long, words binary, counts binary, word binary, code binary, n binary",
    )
    tasks = max(parts, spark.sparkContext.defaultParallelism)
    answers = stage(
        asked.repartition(tasks, "part").groupBy("part").applyInArrow(
            _answered(index, now, matrix, classes), "part int, block long, counts binary, kinds binary, stats array<long>",
        ),
        "answers",
    )
    stats = np.zeros(width + 3, np.int64)
    for r in answers.filter("block = -1").select(F.posexplode("stats").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        stats[r["i"]] = r["n"]
    return blocks, answers, stats, max(whole["blocks"] // 2, spark.sparkContext.defaultParallelism)


def _named(left: pa.Table, right: pa.Table) -> pa.Table:
    """Words of a block with their counts and classes."""
    words = _unpack(left.column("words")[0].as_py()).split(b" ")
    answers = sorted(zip(right.column("part").to_pylist(), right.column("counts").to_pylist(), right.column("kinds").to_pylist(), strict=True))
    count, kind = (np.concatenate([_unpack(a[i], t) for a in answers]) for i, t in ((1, np.int64), (2, np.uint8)))
    some = np.flatnonzero(count > 0)
    return pa.table(
        {"word": pa.array([words[i] for i in some], pa.binary()), "class": pa.array(kind[some].astype(np.int32)), "count": pa.array(count[some])}
    )


def word_classes(
    df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, sweeps: int = SWEEPS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """``word, class, count`` of every word of the training rows (UTF-8 bytes; the end is empty, its class ``classes`` + 1)."""
    blocks, answers, _, count = _fitted(df, held, id_col, text_col, classes, sweeps, frequent)
    of = answers.filter("block >= 0").drop("stats").repartition(count, "block").groupBy("block")
    named = blocks.select("block", "words").repartition(count, "block").groupBy("block").cogroup(of).applyInArrow(
        _named, "word binary, class int, count long",
    )
    return named.distinct()


def brown_scores(
    df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, sweeps: int = SWEEPS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row; scores are log10 probabilities.

    Learns from the rows where ``held`` is false. Tokens are runs outside ASCII white space with A-Z lowered, then one end.
    ``base_score`` is that of single tokens with 0.5 added to each count. An unknown word keeps the class before it as the
    context of what follows. A null text is empty: one token, the end. Repeated rows are texts of their own; other columns are
    not read; with no row to learn from every score is 0; an empty table gives no rows. ``classes`` is at most 120.
    """
    width = classes + 2
    blocks, answers, stats, count = _fitted(df, held, id_col, text_col, classes, sweeps, frequent)
    id_type = df.schema[id_col].dataType
    fields = [
        T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in ("lens", "held", "kinds")),
        T.StructField("base", T.ArrayType(T.DoubleType())), T.StructField("emitted", T.ArrayType(T.DoubleType())),
        T.StructField("known", T.ArrayType(T.LongType())),
    ]
    text_side = blocks.select("block", "ids", "lens", "held", "stream").repartition(count, "block").groupBy("block")
    answer_side = answers.filter("block >= 0").drop("stats").repartition(count, "block").groupBy("block")
    classed = stage(text_side.cogroup(answer_side).applyInArrow(_classed(stats, classes), T.StructType(fields)), "classed")

    moves = np.zeros(width * (width + 1), np.int64)
    for r in classed.select("lens", "held", "kinds").mapInArrow(
        _transitions(classes), "i int, n long",
    ).groupBy("i").agg(F.sum("n").alias("n")).collect():
        moves[r["i"]] = r["n"]
    moves = moves.reshape(width, width + 1).astype(float)
    n, once = float(stats[width]), float(stats[width + 2])
    after = moves[:, :width].sum(axis=1)
    if n:
        share = stats[:width] / n
        unknown = (moves[:, width] + BACKOFF_UNKNOWN * max(once, 1.0) / (n + 2)) / (after + BACKOFF_UNKNOWN)
        unknown = np.clip(unknown, 1e-9, 0.5)
        step = (moves[:, :width] + BACKOFF * share) / (after + BACKOFF)[:, None] * (1 - unknown)[:, None]
    else:
        unknown, step = np.ones(width), np.ones((width, width))
    step = np.log10(np.maximum(step, 1e-300))
    names = [
        ("doc_id", id_type), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()),
        ("base_score", T.DoubleType()), ("score", T.DoubleType()),
    ]
    return classed.mapInArrow(_scores(step, np.log10(unknown), classes, int(n)), T.StructType([T.StructField(a, b) for a, b in names]))
