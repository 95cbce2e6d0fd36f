"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding from byte pieces."""

from __future__ import annotations

import base64
import heapq
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulselake.llm.common import arrow_bytes, blocks, table

#: Buckets of the literal rank map; a few entries each.
BUCKETS = 1 << 14
#: Words of more bytes than this get the same merges from a heap in the Arrow step: folding is quadratic.
LONG_WORD = 64
#: Text bytes of a block, which is one row.
BLOCK_BYTES = 2 << 20
#: Bytes of distinct words that a task remembers from block to block; beyond it starts anew.
MEMORY_BYTES = 6 << 20
#: Words whose ids are put in place at a time.
STEP_WORDS = 100_000
NO_MERGE = 1 << 24


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: maps from token (a character for each byte) to rank, bucketed by CRC-32."""
    slots: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        if len(token) <= LONG_WORD:
            key = token.decode("latin-1")
            slots[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """Token bytes by id (null where there is no such id), as one literal."""
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = base64.b64encode(token).decode()
    return F.from_json(F.lit(json.dumps(pieces)), "array<binary>")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: the finish of a fold over nothing.

    (An element of a one-element transform does the same, but works out its nested type at every call.)
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


class WordFold:
    """The merges of one word, as column expressions over the literal rank map.

    A word is an array of bytes, each a string of one character. A fold keeps the parts so far and, for each
    neighbouring pair, the rank of its merge. A step merges the leftmost pair of lowest rank and looks up only the two
    pairs that change; a word of n bytes takes n - 1 steps at most, and steps that find no merge pass the state on.
    """

    def __init__(self, ranked: Column):
        self.ranked = ranked

    def rank(self, piece: Column) -> Column:
        return F.try_element_at(F.get(self.ranked, (F.crc32(piece) % BUCKETS).cast("int")), piece)

    def merge_rank(self, piece: Column) -> Column:
        return F.coalesce(self.rank(piece), F.lit(NO_MERGE))

    def ids(self, word: Column) -> Column:
        """array<int> of the word's ids; null for words of over LONG_WORD bytes."""
        n = F.length(word)

        def state(parts: Column, pairs: Column) -> Column:
            # The least pair, as rank and place in one number (array_position is slow: it ends by an exception where it finds something).
            low = lambda r: F.array_min(F.transform(r, lambda x, i: x * LONG_WORD + i))
            return _let(pairs, lambda r: F.struct(parts.alias("p"), r.alias("r"), F.coalesce(low(r), F.lit(NO_MERGE * LONG_WORD)).alias("low")))

        def step(acc: Column, _: Column) -> Column:
            p, r = acc["p"], acc["r"]

            def at(k: Column) -> Column:
                def with_merged(m: Column) -> Column:
                    parts = F.transform(p, lambda x, i: F.when(i == k, m).when(i == k + 1, F.lit(None)).otherwise(x))
                    pairs = F.transform(r, lambda x, i: F.when(i == k, F.lit(None))
                                        .when(i == k - 1, self.merge_rank(F.concat(F.get(p, k - 1), m)))
                                        .when(i == k + 1, self.merge_rank(F.concat(m, F.get(p, k + 2)))).otherwise(x))
                    return state(F.array_compact(parts), F.array_compact(pairs))

                return _let(F.concat(F.get(p, k), F.get(p, k + 1)), with_merged)

            return F.when(acc["low"] < NO_MERGE * LONG_WORD, _let(acc["low"] % LONG_WORD, at)).otherwise(acc)

        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: self.merge_rank(F.substring(word, i, F.lit(2))))
        folded = F.aggregate(F.sequence(F.lit(1), n - 1), state(F.split(word, ""), pairs), step, lambda acc: F.transform(acc["p"], self.rank))
        return F.when(n > LONG_WORD, F.lit(None)).otherwise(
            _let(self.rank(word), lambda w: F.when(w.isNotNull() | (n == 1), F.array(w)).otherwise(folded)))


def fold_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<int>>: the ids of each of an array of words. The rank map is bound to a variable, so that the plan
    holds it once, however often the fold looks up."""
    return _let(rank_literal(ranks), lambda ranked: F.transform(words, lambda w: WordFold(ranked).ids(w)))


def joined_pieces(ids: Column, pieces: Column, chunk: int = 512) -> Column:
    """The bytes of ids: pieces are concatenated in chunks, then the chunks."""

    def bytes_of(part: Column) -> Column:
        return F.aggregate(part, F.lit(b""), lambda acc, i: F.concat(acc, F.get(pieces, i)))

    starts = F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1)), F.lit(chunk))
    chunks = F.transform(starts, lambda s: bytes_of(F.slice(ids, s, chunk)))
    return F.aggregate(chunks, F.lit(b""), lambda acc, b: F.concat(acc, b))


def decode(df: DataFrame, ids_col: str, ranks_path: str, out_col: str = "decoded") -> DataFrame:
    """df with the bytes of the ids in ids_col. Null ids: null; no ids: no bytes; an unknown id makes it null."""
    ids = F.col(ids_col)
    return df.withColumn(out_col, F.when(ids.isNull(), F.lit(None)).when(F.size(ids) == 0, F.lit(b"")).otherwise(joined_pieces(ids, piece_literal(load_ranks(ranks_path)))))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: the same merges, kept in a heap over a linked list."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, merged = heapq.heappop(heap)
        j = after[i]
        if not part[i] or j >= n or part[i] + part[j] != merged:
            continue
        part[i], part[j] = merged, b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (pair := part[a] + part[b]) in ranks:
                heapq.heappush(heap, (ranks[pair], a, pair))
    return [ranks[p] for p in part if p]


#: What classes of a pattern mean among ASCII characters: outside a character class, and inside one.
ASCII_CLASSES = {r"\p{L}": ("[A-Za-z]", "A-Za-z"), r"\p{N}": ("[0-9]", "0-9"), r"\s": (r"[\t-\r ]", r"\t-\r "), r"\S": (r"[^\t-\r ]", None)}


def ascii_pattern(pattern: str) -> str | None:
    """A pattern that splits ASCII texts alike and that the standard library's faster matcher takes; None if there is none."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        known = next((k for k in ASCII_CLASSES if pattern.startswith(k, at)), None)
        if known:
            plain = ASCII_CLASSES[known][inside]
            if plain is None:
                return None
            out.append(plain)
            at += len(known)
            continue
        if pattern[at] == "\\":
            return None
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    return "".join(out)


def _split_schema() -> T.StructType:
    return T.StructType([
        T.StructField("anew", T.BooleanType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("codes", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("kept", T.BinaryType()),
    ])


def _split(pattern: str, text_col: str, block_bytes: int, memory_bytes: int):
    """One row for each block of texts: the words that the task hasn't met before, every word's number, words a text, the
    other columns. Words are numbered on from block to block; anew says that numbers begin at 0 again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex  # knows the classes of Unicode

        find = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        find_ascii = re.compile(plain).findall if plain else find

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = len(self)
                return n

        number = Numbers()
        known, remembered = 0, 0
        for part in blocks(batches, text_col, block_bytes):
            anew = remembered >= memory_bytes
            if anew:
                number.clear()
                known = remembered = 0
            codes, counts = [], []
            for text in part[text_col]:
                text = text.as_py() or ""
                found = (find_ascii if text.isascii() else find)(text)
                codes.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                counts.append(len(found))
            fresh = [w.encode() for w in itertools.islice(number, known, None)]
            known, remembered = len(number), remembered + sum(map(len, fresh))
            rest = part.drop_columns([text_col])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            words = pa.array([w.decode("latin-1") for w in fresh], pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.array([anew]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                pa.array([np.concatenate(codes).tobytes() if codes else b""], pa.binary()),
                pa.array([np.array(counts, np.int32).tobytes()], pa.binary()),
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            ], names=["anew", "words", "codes", "counts", "kept"])

    return run


class _Known:
    """What each word of a task so far has become: runs of ids and of bytes, which grow block by block."""

    def __init__(self):
        self.ids, self.data = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.id_ends, self.data_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, id_sizes: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> None:
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(id_sizes)])
        self.data_ends = np.concatenate([self.data_ends, self.data_ends[-1] + np.cumsum(sizes)])
        self.ids, self.data = np.concatenate([self.ids, ids]), np.concatenate([self.data, data])


def _assemble(ranks, kept_schema: pa.Schema):
    """Back from blocks, in the order in which they were split, to texts: ids (packed little-endian unsigned 32-bit) and
    decoded bytes of each text. ranks: a broadcast, read only where a long word occurs."""

    def learn(known: _Known, batch: pa.RecordBatch, row: int) -> None:
        lists, plain = batch["ids"][row].values, batch["bytes"][row].values
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        values = np.asarray(lists.flatten()).astype(np.uint32)
        data, off = arrow_bytes(plain)
        lengths = np.diff(off)
        if not lists.null_count:
            return known.add(values, sizes, data, lengths)
        words, back = batch["words"][row].values, {r: t for t, r in ranks.value.items()}
        ends, own_values, own_data = np.concatenate([[0], np.cumsum(sizes)]), [], []
        at = 0
        for i in np.flatnonzero(np.asarray(lists.is_null())):
            ids = heap_merge(words[int(i)].as_py().encode("latin-1"), ranks.value)
            raw = b"".join(back[x] for x in ids)
            own_values += [values[ends[at] : ends[i]], np.array(ids, np.uint32)]
            own_data += [data[off[at] : off[i]], np.frombuffer(raw, np.uint8)]
            sizes[i], lengths[i], at = len(ids), len(raw), i + 1
        known.add(np.concatenate([*own_values, values[ends[at] :]]), sizes, np.concatenate([*own_data, data[off[at] :]]), lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in batches:
            for row in range(batch.num_rows):
                if batch["anew"][row].as_py():
                    known = _Known()
                learn(known, batch, row)
                codes = np.frombuffer(batch["codes"][row].as_py() or b"", np.int32)
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(batch["counts"][row].as_py(), np.int32), dtype=np.int64)])
                kept = pa.ipc.open_stream(batch["kept"][row].as_py()).read_all()
                at = 0
                while at < kept.num_rows:
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP_WORDS, side="right")) - 1)
                    to = min(to, kept.num_rows)
                    own_codes, mark = codes[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
                    ids, id_off = _gather(known.ids, known.id_ends, own_codes, mark)
                    raw, raw_off = _gather(known.data, known.data_ends, own_codes, mark)
                    part = kept.slice(at, to - at)
                    cols = {f.name: part[f.name].combine_chunks() for f in kept_schema}
                    cols["n_tokens"] = pa.array(np.diff(id_off), pa.int64())
                    cols["ids_le"] = _binary(ids.astype("<u4").view(np.uint8), id_off * 4)
                    cols["decoded"] = _binary(raw, raw_off)
                    yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols.values()], names=list(cols))
                    at = to

    return run


def _gather(values: np.ndarray, off: np.ndarray, codes: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[off[c]:off[c + 1]] for each code c in turn, and where each text's part begins."""
    size = (off[1:] - off[:-1])[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    where = np.repeat(off[:-1][codes] - ends[:-1], size) + np.arange(ends[-1])
    return values[where], ends[mark]


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """docs without its text, with n_tokens long, ids_le binary (ids as little-endian unsigned 32-bit) and decoded binary.

    Narrow steps only: no shuffle, no broadcast that grows, and a lost task is simply run again.
    1. Texts are split by pattern; each block of texts becomes a row with the distinct words that its task hasn't met.
    2. Higher-order functions fold the merges over each such word's bytes, with the rank map as a literal, and
       concatenate the pieces of the ids they give.
    3. Words' ids and bytes are remembered, up to memory_bytes of words, and put back in the order of each text. Steps
       1 and 3 see the same rows of a task in the same order, so both remember the same words.

    Null and empty texts: no tokens. Texts of any length are encoded whole; words of over LONG_WORD bytes get the
    same merges from a heap. Repeated rows are encoded alike; an empty table gives no rows. Columns named n_tokens,
    ids_le or decoded are replaced; others stay.
    """
    ranks = load_ranks(ranks_path)
    docs = docs.drop("n_tokens", "ids_le", "decoded")
    kept_fields = [f for f in docs.schema.fields if f.name != text_col]
    pieces = piece_literal(ranks)
    split = docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(_split(pattern, text_col, block_bytes, memory_bytes), _split_schema())
    encoded = split.withColumn("ids", fold_words(F.col("words"), ranks))

    def plain(lists: Column) -> Column:
        return _let(pieces, lambda p: F.transform(lists, lambda x: F.when(x.isNotNull(), F.aggregate(x, F.lit(b""), lambda acc, i: F.concat(acc, F.get(p, i))))))

    encoded = encoded.withColumn("bytes", plain(F.col("ids")))
    schema = T.StructType([*kept_fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_le", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(_assemble(docs.sparkSession.sparkContext.broadcast(ranks), to_arrow_schema(T.StructType(kept_fields))), schema)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
