"""Dictionaries in the indexed format as tables, and tables as dictionaries.

Many books are written at once, each by one task that streams its payloads in
order, so a task holds a book's index and one payload. Files appear under
temporary names and are moved into place, so a task that runs again replaces
its own files only. Reading gives tables for all books of a folder.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glossa.functions import stardict_kernel as k
from glossa.operators import catalog
from glossa.runtime import partitions

MAX_OFFSET_32 = 1 << 32


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full address, as the executors' file systems take it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    name = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name


def write(items: DataFrame, aliases: DataFrame, folder: str, titles: DataFrame | None = None) -> DataFrame:
    """Write items (book_id, id, word, payload) and aliases (book_id, word, target_id) as one dictionary for each book.

    Equal payloads of a book share a range. Returns a row for each book:
    book_id, entries, synonyms, dict_bytes. Books whose payloads pass 4 GiB
    get 64-bit offsets. Aliases without a target raise an error.
    """
    spark = items.sparkSession
    uri = qualified(spark, folder)
    both = items.select("book_id", F.lit(0).alias("kind"), F.col("id").alias("n"), "word", F.col("payload").cast("binary").alias("payload"))
    both = both.unionByName(aliases.select("book_id", F.lit(1).alias("kind"), F.col("target_id").alias("n"), "word", F.lit(None).cast("binary").alias("payload")))
    if titles is not None:
        both = both.unionByName(titles.select("book_id", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("title").alias("word"), F.lit(None).cast("binary").alias("payload")))
    runs = both.repartition(partitions(spark), "book_id").sortWithinPartitions("book_id", "kind", "n")

    def run(batches):
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        attempt = TaskContext.get().taskAttemptId()
        book = None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if book is None or book.name != r["book_id"]:
                    done += [book.close()] if book else []
                    book = _Book(fs, f"{root}/{r['book_id']}", r["book_id"], attempt)
                book.add(r)
            yield _summary(done)
        yield _summary([book.close()] if book else [])

    return runs.mapInArrow(run, "book_id string, entries long, synonyms long, dict_bytes long")


def write_resources(files: DataFrame, folder: str) -> None:
    """Write files (book_id, file, content) into the ``res`` folder of their book's dictionary."""
    uri = qualified(files.sparkSession, folder)

    def run(batches):
        from pyspark import TaskContext

        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        for batch in batches:
            for r in batch.to_pylist():
                res = f"{root}/{r['book_id']}/res"
                fs.create_dir(res, recursive=True)
                with fs.open_output_stream(f"{res}/_writing-{attempt}", compression=None) as out:
                    out.write(r["content"])
                fs.move(f"{res}/_writing-{attempt}", f"{res}/{r['file']}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files.select("book_id", "file", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _summary(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["book_id", "entries", "synonyms", "dict_bytes"])


class _Book:
    def __init__(self, fs, folder: str, name: str, attempt: int):
        self.fs, self.folder, self.name, self.title, self.attempt = fs, folder, name, name, attempt
        fs.create_dir(folder, recursive=True)
        self.sink = fs.open_output_stream(f"{folder}/_writing-{attempt}")
        self.ranges: dict[bytes, tuple[int, int]] = {}
        self.items: list[tuple[str, int, int, int]] = []
        self.aliases: list[tuple[str, int]] = []
        self.size = 0

    def add(self, r: dict) -> None:
        import hashlib

        if r["kind"] < 0:
            self.title = r["word"] or self.name
        elif r["kind"]:
            self.aliases.append((r["word"], r["n"]))
        else:
            data = r["payload"] or b""
            if not data or b"\0" in data:
                raise k.FormatError("MALFORMED", "empty payload or NUL")
            key = hashlib.sha256(data).digest()
            if key not in self.ranges:
                self.ranges[key] = (self.size, len(data))
                self.sink.write(data)
                self.size += len(data)
            self.items.append((r["word"], r["n"], *self.ranges[key]))

    def close(self) -> tuple[str, int, int, int]:
        self.sink.close()
        self.items.sort(key=lambda x: (*k.order(x[0]), x[1]))
        at = {n: i for i, (_, n, _, _) in enumerate(self.items)}
        if any(n not in at for _, n in self.aliases):
            raise k.FormatError("INCOMPLETE", "alias without an entry")
        syn = sorted(((w, at[n]) for w, n in self.aliases), key=lambda x: (*k.order(x[0]), x[1]))
        bits = 64 if self.size >= MAX_OFFSET_32 else 32
        idx = b"".join(k.index_record(w, o, n, bits) for w, _, o, n in self.items)
        files = {"idx": idx, "syn": b"".join(k.synonym_record(*s) for s in syn), "ifo": catalog.info(self.title, len(self.items), len(syn), len(idx), bits).encode()}
        self.fs.move(f"{self.folder}/_writing-{self.attempt}", f"{self.folder}/dictionary.dict")
        for ext, data in files.items():
            if ext != "syn" or data:
                with self.fs.open_output_stream(f"{self.folder}/_{ext}-{self.attempt}") as out:
                    out.write(data)
                self.fs.move(f"{self.folder}/_{ext}-{self.attempt}", f"{self.folder}/dictionary.{ext}")
        return self.name, len(self.items), len(syn), self.size


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.withColumn("book_id", F.regexp_extract("path", "/([^/]+)/[^/]+$", 1)).withColumn("ext", F.regexp_extract("path", r"\.([a-z]+)$", 1))


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entries (book_id, ordinal, word, offset, size), synonyms (book_id, pos, word, target)) of all books of a folder.

    Only the lengths of payload files are read. A book that breaks a rule of
    the format raises an error.
    """
    index = _files(spark, folder, "dictionary.{ifo,idx,syn}").groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("ext", "content"))).alias("f"))
    sizes = _files(spark, folder, "dictionary.dict").select("book_id", F.col("length").alias("bytes"))
    books = index.join(sizes, "book_id", "left").select("book_id", F.col("f")["ifo"].alias("ifo"), F.col("f")["idx"].alias("idx"), F.coalesce(F.col("f")["syn"], F.lit(b"")).alias("syn"), "bytes")

    def run(what):
        def inner(batches):
            for batch in batches:
                rows = []
                for b in batch.to_pylist():
                    got = k.parse(b["ifo"] or b"", b["idx"] or b"", b["syn"], b["bytes"] or 0)
                    rows += [(b["book_id"], n, *r) for n, r in enumerate(getattr(got, what))]
                names = ["book_id", "ordinal", "word", "offset", "size"] if what == "entries" else ["book_id", "pos", "word", "target"]
                kinds = {"book_id": pa.string(), "word": pa.string()}
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(cols, names, strict=True)], names)

        return inner

    return (
        books.mapInArrow(run("entries"), "book_id string, ordinal long, word string, offset long, size long"),
        books.mapInArrow(run("synonyms"), "book_id string, pos long, word string, target long"),
    )


def payloads(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """Entries with their payload text; each payload file is read once, by the task that has its book."""
    wanted = entries.groupBy("book_id").agg(F.collect_list(F.struct("ordinal", "offset", "size")).alias("rows"))
    both = wanted.join(_files(spark, folder, "dictionary.dict").select("book_id", "content"), "book_id")

    def run(batches):
        for batch in batches:
            out = [(b["book_id"], r["ordinal"], k.payload(b["content"], r["offset"], r["size"])) for b in batch.to_pylist() for r in b["rows"]]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], ["book_id", "ordinal", "payload"])

    return entries.join(both.mapInArrow(run, "book_id string, ordinal long, payload string"), ["book_id", "ordinal"])


def read_back(spark: SparkSession, folder: str, items: DataFrame) -> DataFrame:
    """Differences between what was to be written, (book_id, word, payload), and what a folder holds: none if all is well."""
    from glossa.operators.multiset import difference

    entries, _ = read(spark, folder)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias("sha")
    return difference(items.select("book_id", "word", sha("payload")), payloads(spark, folder, entries).select("book_id", "word", sha("payload")), ["book_id", "word", "sha"])


def pack(files: dict[str, bytes]) -> bytes:
    """A deterministic archive: fixed times, images stored, everything else deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in sorted(files, key=str.encode):
            entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            entry.external_attr = 0o644 << 16
            image = name.rsplit(".", 1)[-1].lower() in ("png", "jpg", "jpeg", "gif")
            z.writestr(entry, files[name], zipfile.ZIP_STORED if image else zipfile.ZIP_DEFLATED, None if image else 6)
    return out.getvalue()


def unpack(data: bytes, budget: int) -> dict[str, bytes]:
    """The members of an archive with one dictionary, if their summed size is within the budget."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if sum(i.file_size for i in infos) + len(data) > budget:
            raise k.FormatError("LIMIT", "inflated size")
        if sum(i.filename.endswith(".ifo") for i in infos) != 1:
            raise k.FormatError("UNSUPPORTED", "not one dictionary")
        try:
            return {i.filename: z.read(i) for i in infos if not i.is_dir()}
        except (zipfile.BadZipFile, zlib.error) as e:
            raise k.FormatError("MALFORMED", str(e)) from e


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """Each dictionary below the path is a partition."""

    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "entries")

    def partitions(self):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        return [_Part(f.path.removesuffix(".ifo")) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".ifo")]

    def read(self, partition):
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        get = lambda ext: fs.open_input_stream(f"{partition.path}.{ext}").read() if fs.get_file_info(f"{partition.path}.{ext}").type == pyarrow.fs.FileType.File else b""
        got = k.parse(get("ifo"), get("idx"), get("syn"), fs.get_file_info(f"{partition.path}.dict").size)
        book = partition.path.rsplit("/", 2)[-2]
        for n, row in enumerate(got.entries if self.table == "entries" else got.synonyms):
            yield (book, n, *row)


class StarDictSource(DataSource):
    """``spark.read.format("stardict").option("table", "entries" | "synonyms").load(path)``."""

    @classmethod
    def name(cls):
        return "stardict"

    def schema(self):
        return "book_id string, ordinal long, word string, offset long, size long" if self.options.get("table", "entries") == "entries" else "book_id string, pos long, word string, target long"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StarDictSource)
