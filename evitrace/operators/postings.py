"""Inverted index tables: tokens, facets, relations and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evitrace.functions.analyze import Counted, count_texts, fold_name, tokens_of
from evitrace.session import cut_lineage

#: Postings an Arrow function hands on at once, and those that are sorted into blocks at once.
ROWS_AT_ONCE, BLOCK = 100_000, 400_000
#: Characters whose tokens are counted at once.
LETTERS = 2_000_000
#: Stands between the tokens of an entry; the analyzer splits at it, so no token has it.
BETWEEN = "\x1f"


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Counted]]:
    """Entries of a batch whose last column is the array of an entry's texts, and the tokens of all
    those texts, in portions of about ``LETTERS`` characters."""
    texts = batch.columns[-1]
    given = pc.list_value_length(texts).to_numpy()
    if not given.any():  # no fields
        return
    letters = np.add.reduceat(pc.utf8_length(texts.flatten()).to_numpy(), np.cumsum(given) - given)
    for at, end in _portions(letters, LETTERS):
        part = batch.slice(at, end - at)
        yield part, count_texts(part.columns[-1].flatten().to_pylist())


def _counter(names: list[str], schema: T.StructType):
    """Postings of batches whose last column is the array of an entry's texts, in the order of ``names``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, labels = to_arrow_schema(schema), pa.array(names, pa.string())
        for batch in batches:
            for part, found in _counted(batch):
                row, field = np.divmod(found.text, len(names))
                columns = [found.tokens, *[c.take(pa.array(row)) for c in part.columns[:-1]], labels.take(pa.array(field)),
                           pa.array(found.tf), pa.array(found.sizes[found.text])]
                made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], names=shape.names)
                for at in range(0, made.num_rows, ROWS_AT_ONCE):
                    yield made.slice(at, ROWS_AT_ONCE)

    return count


def _packer(fields: int, schema: T.StructType):
    """Packed rows, one per entry with postings, of batches as :func:`_counter` takes them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(schema)
        for batch in batches:
            for part, found in _counted(batch):
                per = np.bincount(found.text, minlength=len(found.sizes))
                n = per.reshape(-1, fields).sum(1)
                ends = np.concatenate(([0], np.cumsum(n)))
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found.tokens)
                sizes, tfs = np.stack([per, found.sizes], 1).astype("<i4"), found.tf.astype("<i4")
                columns = [*part.columns[:-1], pa.array(n), pc.binary_join(tokens, BETWEEN),
                           _binary(sizes, np.arange(len(n) + 1) * fields * 8), _binary(tfs, ends * 4)]
                made = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], names=shape.names)
                yield made.filter(pa.array(n > 0))

    return pack


def _binary(numbers: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that are the bytes of ``numbers`` between ``offsets``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(numbers.tobytes())])


def _data(array: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    """Offsets of a string or binary array and the bytes they point into."""
    _, offsets, data = array.buffers()
    return np.frombuffer(offsets, np.int32)[array.offset:array.offset + len(array) + 1], data


def _numbers(array: pa.Array) -> np.ndarray:
    """The 32-bit numbers of all binary values of an array, in a row."""
    offsets, data = _data(array)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view("<i4") if offsets[-1] > offsets[0] else np.zeros(0, "<i4")


def _portions(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, so that their counts add up to ``most`` or are one row's."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _slices(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """The bytes of consecutive values as one binary value for each stretch between ``starts``."""
    offsets, data = _data(values)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets[starts].tobytes()), data])


def _blocks(value: pa.Array, carried: list[pa.Array], row: np.ndarray, numbers: list[np.ndarray]) -> list[pa.Array]:
    """Blocks of equal values: (value, first of the first carried column, rows, bytes of the carried
    strings at ``row``, then their lengths and ``numbers``, row by row)."""
    coded = value.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    starts = np.concatenate(([0], np.cumsum(counts)))
    texts, lengths = [], []
    for column in carried:
        taken = column.take(pa.array(row[order]))
        texts.append(_slices(taken, starts))
        lengths.append(np.where(taken.is_null().to_numpy(zero_copy_only=False), -1, np.diff(_data(taken)[0])))
        if len(texts) == 1:
            low = taken.take(pa.array(starts[:-1]))
    held = np.stack([*lengths, *[x[order] for x in numbers]], 1).astype("<i4")
    return [coded.dictionary, low, pa.array(counts.astype(np.int32)), *texts, _binary(held, starts * 4 * held.shape[1])]


def _opened(texts: list[pa.Array], held: np.ndarray) -> list[pa.Array]:
    """The carried strings of blocks, row by row."""
    found = []
    for i, column in enumerate(texts):
        offsets, data = _data(column)
        ends = offsets[0] + np.concatenate(([0], np.cumsum(np.maximum(held[:, i], 0))))
        made = pa.Array.from_buffers(pa.string(), len(held), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data])
        missing = held[:, i] < 0
        found.append(pc.if_else(pa.array(missing), pa.scalar(None, pa.string()), made) if missing.any() else made)
    return found


def _entry_rows(batch: pa.RecordBatch, carried: int, fields: int) -> Iterator[tuple]:
    """(tokens, carried columns, row, field, tf, size) of the postings of packed rows, in portions."""
    names = batch.schema.names
    for at, end in _portions(batch.column(names.index("n")).to_numpy(), BLOCK):
        part = batch.slice(at, end - at)
        tokens = pc.split_pattern(part.column(names.index("tokens")), BETWEEN).flatten()
        per = _numbers(part.column(names.index("sizes"))).reshape(-1, 2)
        row = np.repeat(np.repeat(np.arange(end - at), fields), per[:, 0])
        field = np.repeat(np.tile(np.arange(fields), end - at), per[:, 0])
        yield tokens, part.columns[:carried], row, field, _numbers(part.column(names.index("tfs"))), np.repeat(per[:, 1], per[:, 0])


def unpacked(packed: DataFrame, fields: list[str]) -> DataFrame:
    """Postings of packed rows (:func:`token_postings`), a row each; columns after ``tfs`` are kept."""
    names = packed.columns
    first = names.index("n")
    carried = [*names[:first], *names[names.index("tfs") + 1:]]
    given = packed.select(*carried, "n", "tokens", "sizes", "tfs")
    schema = T.StructType([
        T.StructField("token", T.StringType()), *given.schema.fields[:len(carried)], T.StructField("field", T.StringType()),
        T.StructField("tf", T.IntegerType()), T.StructField("size", T.IntegerType()),
    ])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, labels = to_arrow_schema(schema), pa.array(fields, pa.string())
        for batch in batches:
            for tokens, held, row, field, tf, size in _entry_rows(batch, len(carried), len(fields)):
                columns = [tokens, *[c.take(pa.array(row)) for c in held], labels.take(pa.array(field)), pa.array(tf), pa.array(size)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], names=shape.names)

    return given.mapInArrow(unpack, schema)


def sorted_postings(packed: DataFrame, fields: list[str]) -> DataFrame:
    """Postings of packed rows, a row each, divided by ranges of (token, entry) and sorted by token.

    Blocks move, not rows: up to ``BLOCK`` postings of a task's entries are grouped by token, so
    that sorting compares a block's token and first entry. Postings of a token lie in blocks, in
    each of them in the order of the entries given. Carried columns are strings.
    """
    names = packed.columns
    carried = names[:names.index("n")]
    moved = [f"_text{i}" for i in range(len(carried))]
    texts = ", ".join(f"{m} binary" for m in moved)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, held, row, *numbers in _entry_rows(batch, len(carried), len(fields)):
                yield pa.RecordBatch.from_arrays(_blocks(tokens, held, row, numbers), ["token", "_low", "_n", *moved, "_numbers"])

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(fields, pa.string())
        for batch in batches:
            counts = batch.column(2).to_numpy()
            for at, end in _portions(counts, ROWS_AT_ONCE):
                part = batch.slice(at, end - at)
                held = _numbers(part.column(3 + len(moved))).reshape(-1, len(moved) + 3)
                field, tf, size = (held[:, len(moved) + i] for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(end - at), counts[at:end]))), *_opened(part.columns[3:3 + len(moved)], held),
                     labels.take(pa.array(field)), pa.array(tf), pa.array(size)], ["token", *carried, "field", "tf", "size"])

    # Dividing by ranges reads its rows twice: blocks are written before.
    blocks = cut_lineage(packed.mapInArrow(group, f"token string, _low string, _n int, {texts}, _numbers binary"))
    blocks = blocks.repartitionByRange("token", "_low").sortWithinPartitions("token", "_low")
    return blocks.mapInArrow(open_blocks, f"token string, {', '.join(f'{c} string' for c in carried)}, field string, tf int, size int")


def _analyzed(entries: DataFrame, fields: dict[str, Column], *keep: str) -> DataFrame:
    return entries.select(*keep, tokens_of(*fields.values()).alias("_tok"))


def _named(fields, values: Column) -> Column:
    """An array of per-field values as ``{field, value}`` structs."""
    names = F.array(*[F.lit(f) for f in fields])
    return F.zip_with(names, values, lambda f, v: F.struct(f.alias("field"), v.alias("value")))


def token_postings(entries: DataFrame, fields: dict[str, Column], id_col: str = "identity",
                   keep: list[str] | None = None, packed: bool = False) -> DataFrame:
    """One row per (token, entry, field): frequency, size of the field, and the ``keep`` columns.

    ``fields`` maps names to text columns. An entry's tokens are counted inside its own row, so
    nothing is shuffled and a token held by a third of the corpus is no different from any other.
    Counting reads each text once in an Arrow function, many texts at a time: distinct runs of
    characters are expanded, not every occurrence. ``packed``: the same postings, those of an entry in one row (``n`` of
    them: tokens joined, per field their number and its size, frequencies); :func:`unpacked` and
    :func:`sorted_postings` give rows of them. Entries without postings have no row.
    """
    carried = [id_col, *(keep or [])]
    texts = F.array(*[F.coalesce(c, F.lit("")) for c in fields.values()])
    given = entries.select(*carried, texts.alias("_texts"))
    if packed:
        schema = T.StructType([
            *given.schema.fields[:-1], T.StructField("n", T.IntegerType()), T.StructField("tokens", T.StringType()),
            T.StructField("sizes", T.BinaryType()), T.StructField("tfs", T.BinaryType()),
        ])
        return given.mapInArrow(_packer(len(fields), schema), schema)
    schema = T.StructType([
        T.StructField("token", T.StringType()), *given.schema.fields[:-1], T.StructField("field", T.StringType()),
        T.StructField("tf", T.IntegerType()), T.StructField("size", T.IntegerType()),
    ])
    return given.mapInArrow(_counter(list(fields), schema), schema)


def document_frequency(entries: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Entries per token, a token counting once per entry whatever the field.

    Distinctness is settled inside the row; the count combines map-side.
    """
    return (
        _analyzed(entries, fields).select(F.explode(F.array_distinct(F.flatten("_tok"))).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("document_frequency"))
    )


def field_lengths(entries: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Mean token count per field over every entry, empty fields included."""
    sizes = _analyzed(entries, fields).select(
        F.explode(_named(fields, F.transform("_tok", lambda held: F.size(held)))).alias("s")
    )
    return sizes.groupBy("s.field").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("s.value").cast("bigint")).alias("tokens"),
    ).withColumn("average_length", F.round(F.col("tokens") / F.col("documents"), 4))


def fields_of(entries: DataFrame, columns: dict[str, Column]) -> dict[str, str]:
    """Type names of columns over the entries."""
    return {f.name: f.dataType.typeName() for f in entries.select(*[c.alias(k) for k, c in columns.items()]).schema.fields}


def facet_postings(entries: DataFrame, facets: dict[str, Column], id_col: str = "identity", ordered: bool = False) -> DataFrame:
    """One row per (facet, folded value, entry); multi-valued facets give one row per value.

    ``ordered``: rows of a partition are sorted by facet and value, for identities that are strings.
    Values of a list are grouped before, up to ``BLOCK`` of them, so that groups are sorted and not rows.
    """
    listed = {k for k, c in fields_of(entries, facets).items() if c == "array"}
    single = [F.struct(F.lit(k).alias("facet"), c.cast("string").alias("value")) for k, c in facets.items() if k not in listed]
    folded = lambda rows: rows.filter(F.col("value").isNotNull()).select("facet", fold_name(F.col("value"), exact=False).alias("value"), *rows.columns[2:])
    # Values of a list are taken from it directly; only those of the other facets are put side by side.
    parts = [folded(entries.select(id_col, F.explode(F.array(*single)).alias("f")).select("f.facet", "f.value", id_col))] if single else []
    if ordered:
        parts = [p.sortWithinPartitions("facet", "value") for p in parts]
        for k in [k for k in facets if k in listed]:
            blocks = entries.select(id_col, facets[k].cast("array<string>").alias("values")).mapInArrow(
                _group_values, "value string, _low string, _n int, _text binary, _numbers binary")
            blocks = folded(blocks.select(F.lit(k).alias("facet"), "value", "_n", "_text", "_numbers")).sortWithinPartitions("value")
            parts.append(blocks.mapInArrow(_open_values, "facet string, value string, _id string").withColumnRenamed("_id", id_col))
        return reduce(DataFrame.unionByName, parts)
    parts += [folded(entries.select(F.lit(k).alias("facet"), F.explode(facets[k].cast("array<string>")).alias("value"), id_col)) for k in facets if k in listed]
    return reduce(DataFrame.unionByName, parts)


def _group_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of equal values of (identity, list of values)."""
    for batch in batches:
        counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
        for at, end in _portions(counts, BLOCK):
            part = batch.slice(at, end - at)
            values, row = part.column(1).flatten(), np.repeat(np.arange(end - at), counts[at:end])
            if values.null_count:
                held = values.is_valid()
                values, row = values.filter(held), row[held.to_numpy(zero_copy_only=False)]
            if len(values):
                yield pa.RecordBatch.from_arrays(_blocks(values, [part.column(0)], row, []), ["value", "_low", "_n", "_text", "_numbers"])


def _open_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(facet, value, identity) of blocks, a row each."""
    for batch in batches:
        counts = batch.column(2).to_numpy()
        for at, end in _portions(counts, ROWS_AT_ONCE):
            part = batch.slice(at, end - at)
            row = pa.array(np.repeat(np.arange(end - at), counts[at:end]))
            found = _opened([part.column(3)], _numbers(part.column(4)).reshape(-1, 1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), *found], ["facet", "value", "_id"])


def zero_filled(counts: DataFrame, key: str, dimension: list[str], count: str = "entries") -> DataFrame:
    """Counts with a row for every member of a small closed dimension."""
    spark = counts.sparkSession
    dim = spark.createDataFrame([(v, i) for i, v in enumerate(dimension)], f"{key} string, ord int")
    # The dimension is a closed vocabulary of a few names; counts has at most one row per name.
    return dim.join(counts, key, "left").select(
        key, F.coalesce(count, F.lit(0)).cast("bigint").alias(count)
    )
