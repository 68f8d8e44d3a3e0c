"""Token ids in Arrow files of fixed-size lists.

Documents in ascending order of identifier form one stream of ids, each followed by an end id. A task writes its range
of documents as sequences of equal length in record batches of the Arrow file format; a mask of equal shape has 1 for
ids and 0 for the padding at a file's end. Ids are 16 bits wide where the vocabulary allows, and the mask one. A second small Arrow file beside it says where each document starts.
Readers map the files into memory, so any sequence or document is reached without decoding what stands before it.

Defined cases: a null text is empty and has the end id alone; rows with one identifier follow each other in order of
text; a null identifier comes last; an empty table gives no files. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .files import mapped_input, whole_output
from .tokens import encoder

SEQUENCE = 2048
#: Sequences in a record batch.
BATCH = 64
#: Texts that are encoded together.
TEXTS = 1024
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = "part int, path string, n_docs long, n_tokens long"


def _schema(sequence: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


def _writer(folder: str, tokenizer: str, end_id: int, sequence: int):
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.release_memory()
        part, words = TaskContext.get().partitionId(), encoder(tokenizer)
        encode, schema = words.encode, _schema(sequence, max(len(words.lengths) - 1, end_id) >= 1 << 16)
        path, step = f"{folder}/part-{part:06d}", BATCH * sequence
        docs = tokens = 0
        held = bytearray()
        with whole_output(f"{path}.arrow") as out, whole_output(f"{path}.index.arrow") as index_out, pa.ipc.new_file(out, schema) as file, pa.ipc.new_file(index_out, _INDEX) as index:

            def put(n: int) -> None:
                ids = np.frombuffer(bytes(held[: n * 4]), "<u4")
                del held[: n * 4]
                rows = -(-n // sequence)
                flat, mask = np.zeros(rows * sequence, schema.field("ids").type.value_type.to_pandas_dtype()), np.zeros(rows * sequence, bool)
                flat[:n], mask[:n] = ids, True
                file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((flat, mask), schema)], schema=schema))

            for batch in batches:
                for a in range(0, batch.num_rows, TEXTS):
                    own = batch.slice(a, TEXTS)
                    found = [x + end for x in encode(own.column("text").to_pylist())]
                    n = np.array([len(x) // 4 for x in found], np.int64)
                    starts = tokens + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                    index.write_batch(pa.RecordBatch.from_arrays([own.column("id").cast(pa.int64()), pa.array(starts), pa.array(n)], schema=_INDEX))
                    docs, tokens = docs + len(found), tokens + int(n.sum())
                    for x in found:
                        held += x
                        while len(held) >= step * 4:
                            put(step)
            if held:
                put(len(held) // 4)
        if docs:
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": docs, "n_tokens": tokens}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; a table with a row for each: part, path without ending, n_docs, n_tokens."""
    shared.bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(shared.id_or_last(id_col).alias("id"), shared.text_or_empty(text_col).alias("text"))
    in_order = rows.repartitionByRange(shared.partitions_for(spark, 0), "id").sortWithinPartitions("id", "text")
    return shared.written(in_order.mapInArrow(_writer(folder, tokenizer, end_id, sequence), _MANIFEST), "manifest")


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row for each document in the files: doc_id, start in the whole stream, n_tokens and ids (little-endian, 32 bits)."""
    return _read(spark, manifest, "doc_id long, start long, n_tokens long, ids binary", _with_ids)


def read_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """As read_documents, with the checksum ids_crc32 for the ids."""
    return _read(spark, manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", _with_crc)


def _read(spark: SparkSession, manifest: DataFrame, ddl: str, finish) -> DataFrame:
    files = manifest.orderBy("part").collect()  # a row for each file
    starts = np.concatenate([[0], np.cumsum([f["n_tokens"] for f in files])]).astype(int).tolist()
    rows = [(k, f["path"], starts[k]) for k, f in enumerate(files)]
    listed = spark.createDataFrame(rows, "k int, path string, base long").repartitionById(max(1, len(rows)), F.col("k"))
    return listed.mapInArrow(_reader(finish), ddl)


def _with_ids(pieces: list[bytes]) -> bytes:
    return b"".join(pieces)


def _with_crc(pieces: list[bytes]) -> int:
    crc = 0
    for x in pieces:
        crc = zlib.crc32(x, crc)
    return crc


def _reader(finish):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with mapped_input(f"{row['path']}.arrow") as source, mapped_input(f"{row['path']}.index.arrow") as index_source:
                    file, index = pa.ipc.open_file(source), pa.ipc.open_file(index_source)
                    at, flat, sequence = -1, None, file.schema.field("ids").type.list_size
                    step = BATCH * sequence
                    for k in range(index.num_record_batches):
                        own = index.get_batch(k)
                        out = []
                        for start, n in zip(own["start"].to_pylist(), own["n_tokens"].to_pylist()):
                            pieces, end = [], start + n
                            while start < end:
                                if start // step != at:
                                    at = start // step
                                    flat = file.get_batch(at).column("ids").flatten().to_numpy()
                                stop = min(end, (at + 1) * step)
                                pieces.append(flat[start - at * step : stop - at * step].astype("<u4", copy=False).tobytes())
                                start = stop
                            out.append(finish(pieces))
                        ids = own["doc_id"].to_numpy()
                        last = pa.array(out, pa.binary() if finish is _with_ids else pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == shared.LAST_ID), pa.array(own["start"].to_numpy() + row["base"]), own["n_tokens"], last], names=["doc_id", "start", "n_tokens", "ids" if finish is _with_ids else "ids_crc32"])

    return read
