"""Text folders into chunks, and model responses into candidates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlog.functions.literals import quote
from graphlog.functions.text import joined_hash
from graphlog.storage import file_system, materialise

# Largest file read, and characters a chunk repeats.
MAX_BYTES = 1 << 20
OVERLAP = 200

_BLOCK = 512
# Entries and folders that one task lists, files and bytes that one reads, and bytes it holds.
_ENTRIES, _FOLDERS = 10_000, 5_000
_FILES, _LOAD, _HELD = 20_000, 128 << 20, 4 << 20


def _glob_pattern(glob: str) -> str:
    """A glob over relative paths as a regular expression; ``**/`` is any folders or none."""
    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def write_folder(texts: DataFrame, folder: str, by: str) -> None:
    """Each row's ``text`` as a file of its own, a line feed at its end, below the folder ``by=value``.

    Hadoop's local file system starts a process for each file, and one for its
    checksum file, to set their modes; there the tasks write the files
    themselves. Elsewhere Spark's writer does. A task that runs again writes
    the same names, each put in place when it is whole.
    """
    files, where = file_system(texts.sparkSession, folder)
    if files.getUri().getScheme() != "file":
        texts.select(by, "text").write.partitionBy(by).text(folder)
        return
    top = where.toUri().getPath()

    def write(batches):
        import os
        from collections import Counter
        from urllib.parse import quote as escaped

        import pyarrow as pa
        from pyspark import TaskContext

        task, met = TaskContext.get(), Counter()
        for batch in batches:
            for value, text in zip(*(column.to_pylist() for column in batch.columns)):
                below = f"{top}/{by}={'__HIVE_DEFAULT_PARTITION__' if value is None else escaped(value, safe=' ')}"
                name = f"part-{task.partitionId():05}-{met[value]}.txt"
                met[value] += 1
                os.makedirs(below, exist_ok=True)
                with open(f"{below}/_{name}-{task.taskAttemptId()}", "wb") as out:
                    out.write((text or b"") + b"\n")
                os.replace(out.name, f"{below}/{name}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    texts.select(F.col(by).cast("string"), F.col("text").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _below(top: str):
    """Folders (``path`` under ``top``) -> the files below them, and folders left over, whose ``size`` is null.

    What Spark's readers pass over is passed over (hidden names, empty files),
    links are followed. From one folder on, a task goes through ``_ENTRIES``
    entries, and to the end of the folder it is in; the folders it has not
    come to by then are left over.
    """

    def run(batches):
        import errno
        import os

        import pyarrow as pa

        kinds = {"path": pa.string(), "size": pa.int64(), "mtime": pa.int64()}

        def entries(start):
            todo, met = [start], 0
            while todo and met < _ENTRIES:
                folder = todo.pop()
                with os.scandir(f"{top}/{folder}") as names:
                    for entry in names:
                        name = entry.name
                        passed = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
                        try:
                            name.encode()  # what is not UTF-8 the JVM cannot open
                            path, met = f"{folder}/{name}" if folder else name, met + 1
                            if not entry.is_dir():
                                state = entry.stat()
                                if state.st_size and not passed:
                                    yield path, state.st_size, state.st_mtime_ns // 1_000_000
                            elif not passed or name.startswith(("_metadata", "_common_metadata")):
                                if met < _ENTRIES:
                                    todo.append(path)
                                else:
                                    yield path, None, None
                        except UnicodeEncodeError:
                            continue
                        except OSError as error:  # gone meanwhile, or a link to nothing or to itself
                            if error.errno not in (errno.ENOENT, errno.ELOOP):
                                raise
            for path in todo:
                yield path, None, None

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=[*kinds])

        rows = []
        for batch in batches:
            for start in batch.column("path").to_pylist():
                for row in entries(start):
                    rows.append(row)
                    if len(rows) == _ENTRIES:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    return run


def _contents(top: str):
    """Files (``path`` under ``top``) -> the same with their ``content``, a few MB at a time.

    A checksum file that Hadoop left beside a file must agree with it.
    """

    def run(batches):
        import zlib

        import pyarrow as pa

        def checked(path, content):
            folder, _, name = path.rpartition("/")
            try:
                with open(f"{folder}/.{name}.crc", "rb") as file:
                    sums = file.read()
            except FileNotFoundError:
                return content
            each = int.from_bytes(sums[4:8])
            if sums[:4] == b"crc\0" and each:
                own = b"".join(zlib.crc32(content[i:i + each]).to_bytes(4) for i in range(0, len(content), each))
                if own != sums[8:]:
                    raise OSError(f"{path} differs from its checksum file")
            return content

        for batch in batches:
            read, held, start = [], 0, 0
            for at, path in enumerate(batch.column("path").to_pylist(), 1):
                with open(f"{top}/{path}", "rb") as file:
                    read.append(checked(file.name, file.read()))
                held += len(read[-1])
                if held >= _HELD or at == batch.num_rows:
                    columns = [*batch.slice(start, at - start).columns, pa.array(read, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "content"])
                    read, held, start = [], 0, at

    return run


def _listed(spark: SparkSession, top: str, wanted: Column) -> DataFrame:
    """(path, size, mtime) of the wanted files below a folder of a local or shared disk.

    Tasks list, a round for the folders that the one before left over; what
    they find is written out, so that no list of files is held as a whole.
    """
    schema = "path string, size long, mtime long"
    found, todo, count = [], spark.createDataFrame([("",)], "path string"), 1
    while count:
        tasks = todo.repartition(-(-count // _FOLDERS), "path")
        here = materialise(tasks.mapInArrow(_below(top), schema).filter(F.col("size").isNull() | wanted))
        found.append(here.filter("size IS NOT NULL"))
        todo = here.filter("size IS NULL").select("path")
        count = todo.count()
    return reduce(DataFrame.unionByName, found)


def _read(files: DataFrame, top: str) -> DataFrame:
    """``files`` with their ``content``, dealt to tasks by their number and bytes."""
    total = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    few = min(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total.n // 500))
    tasks = max(1, few, -(-total.n // _FILES), -(-total.bytes // _LOAD))
    return files.repartition(tasks, "path").mapInArrow(_contents(top), "path string, size long, mtime long, content binary")


def scan_folder(spark: SparkSession, folder: str, glob: str = "**/*.md", max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, dead letters) of the matching files below ``folder``.

    The whole relative path is matched. The content of a file that is too
    large is never read; a file that is not UTF-8 is one dead letter. Spark's
    reader lists all files on the driver, so below a folder of a local or
    shared disk tasks list and read them; elsewhere Spark's reader does.
    """
    name = glob.rsplit("/", 1)[-1]
    disk, where = file_system(spark, folder)
    own = disk.getUri().getScheme() == "file" and not set(folder) & set("{}[]*?\\")  # such a folder is a pattern to Spark's reader
    if own and disk.exists(where) and disk.getFileStatus(where).isDirectory():
        top = disk.makeQualified(where).toUri().getPath()
        # as pathGlobFilter has it
        named = "(?s)^(?:" + spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(name).compiled().pattern() + r")\z"
        wanted = F.substring_index("path", "/", -1).rlike(named) & F.col("path").rlike(_glob_pattern(glob))
        files = _listed(spark, top, wanted)
        small = _read(files.filter(F.col("size") <= max_bytes), top)
    else:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder)
        relative = F.substring_index("path", folder.rstrip("/") + "/", -1)
        files = read.filter(relative.rlike(_glob_pattern(glob))).select(
            relative.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content"
        )
        small = files.filter(F.col("size") <= max_bytes)
    text = F.col("content").cast("string")
    docs = small.filter(F.is_valid_utf8(text)).select("path", "mtime", "size", text.alias("text"))
    too_large = files.filter(F.col("size") > max_bytes).select(
        F.lit("FILE_TOO_LARGE").alias("reason"),
        F.concat("path", F.lit(f" is larger than {max_bytes} bytes")).alias("detail"),
        F.to_json(F.struct("path", "size")).alias("raw_payload"),
    )
    unreadable = small.filter(~F.is_valid_utf8(text)).select(
        F.lit("IO_ERROR").alias("reason"),
        F.concat("path", F.lit(" is not UTF-8 text")).alias("detail"),
        F.to_json(F.struct("path", "size")).alias("raw_payload"),
    )
    return docs, too_large.unionByName(unreadable)


def changed_documents(documents: DataFrame, previous: DataFrame) -> DataFrame:
    """Documents that are new or whose text hash differs from last time."""
    hashed = documents.withColumn("content_hash", F.sha2("text", 256))
    return hashed.join(previous.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def document_id(connector: Column, path: Column, mtime: Column) -> Column:
    return joined_hash(connector, path, mtime.cast("string"))


def change_id(document: Column, node_type: Column, name: Column) -> Column:
    return joined_hash(document, node_type, name)


def chunk_range(offset: Column, length: Column) -> Column:
    return F.concat_ws(":", offset.cast("string"), length.cast("string"))


def _overlapped(pieces: str, overlap: int) -> Column:
    """Put the end of the piece before ahead of each one."""
    if overlap <= 0:
        return F.col(pieces)
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            F.when(i > 0, F.concat(F.right(F.get(F.col(pieces), i - 1)["text"], F.lit(overlap)), p["text"]))
            .otherwise(p["text"]).alias("text"),
            p["char_offset"].alias("char_offset"),
            p["char_length"].alias("char_length"),
        ),
    )


def _prefix_sums(numbers: Column, start: Column) -> Column:
    """What comes before each number, counted from ``start``."""
    walked = F.aggregate(
        numbers,
        F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
    )
    return walked["out"]


def _chunks(documents: DataFrame, parts: Column, gaps: Column, overlap: int) -> DataFrame:
    """One row per part that is not blank, with its offset; gap i follows
    part i.

    Offsets are summed in blocks, as appending to one array per part would be
    quadratic in the parts of a document. Each step is a column of its own,
    so that no step is worked out again inside the next.
    """
    rest = [c for c in documents.columns if c != "text"]
    cut = documents.select(*rest, parts.alias("_parts"), gaps.alias("_gaps"))
    sizes = F.zip_with("_parts", "_gaps", lambda p, g: F.length(p) + F.coalesce(F.length(g), F.lit(0)))
    sized = cut.select(*rest, "_parts", sizes.alias("_sizes"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_sizes"), F.lit(1)), F.lit(_BLOCK))
    blocks = sized.select(*rest, "_parts", F.transform(starts, lambda s: F.slice("_sizes", s, F.lit(_BLOCK))).alias("_blocks"))
    totals = F.transform("_blocks", lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
    based = blocks.select(*rest, "_parts", "_blocks", _prefix_sums(totals, F.lit(0)).alias("_bases"))
    at = F.flatten(F.zip_with("_blocks", "_bases", lambda b, o: _prefix_sums(b, o)))
    placed = based.select(*rest, "_parts", at.alias("_at"))
    pieces = F.zip_with(
        "_parts", "_at", lambda p, o: F.struct(p.alias("text"), o.alias("char_offset"), F.length(p).alias("char_length"))
    )
    kept = placed.select(*rest, F.filter(pieces, lambda p: p["text"].rlike(r"\S")).alias("_kept"))
    chunks = kept.select(*rest, F.posexplode(_overlapped("_kept", overlap)).alias("chunk_index", "_c"))
    return chunks.select(*rest, "chunk_index", "_c.text", "_c.char_offset", "_c.char_length")


def paragraph_chunks(documents: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Chunks between blank lines; offset and length leave out the overlap."""
    parts = F.split("text", r"\n{2,}", -1)
    gaps = F.regexp_extract_all("text", F.lit(r"(\n{2,})"), 1)
    return _chunks(documents, parts, gaps, overlap)


def sentence_chunks(documents: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Chunks that end after ``!`` or ``?`` and white space, or after a full
    stop and white space unless a lower-case letter follows.

    A line break is white space like any other.
    """
    pattern = r"""(?s)(.*?(?:[!?]["')\]]*[ \t\r\n]++|[.]["')\]]*[ \t\r\n]++(?!\p{Ll})|\z))"""
    parts = F.regexp_extract_all("text", F.lit(pattern), 1)
    return _chunks(documents, parts, F.array().cast("array<string>"), overlap)


_CANDIDATE = (
    "array<struct<typeSlug:string,name:string,properties:map<string,variant>,sourceSpan:struct<offset:int,length:int>,"
    "confidence:decimal(4,3),relationships:array<struct<type:string,target:string>>>>"
)


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, dead letters) from the text a model sent back.

    A code fence around the JSON array is taken off. ``responses`` has a
    ``response`` column and whatever names its document and chunk.
    """
    clean = F.trim(F.regexp_replace("response", r"^\s+|\s+$", ""))
    fence = r"^```[A-Za-z]*\s*|\s*```$"
    text = F.when(clean.startswith("```"), F.regexp_replace(clean, fence, "")).otherwise(clean)
    rest = [c for c in responses.columns if c != "response"]
    whole = F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY")
    parsed = responses.withColumn("_list", F.when(whole, F.from_json(text, _CANDIDATE)))
    rows = parsed.filter(F.col("_list").isNotNull()).select(*rest, F.explode("_list").alias("c")).select(
        *rest,
        F.col("c.typeSlug").alias("type"),
        F.col("c.name").alias("name"),
        F.col("c.properties").alias("extracted"),
        F.col("c.sourceSpan").alias("source_span"),
        F.col("c.confidence").alias("confidence"),
        F.col("c.relationships").alias("relationships"),
    )
    bad = parsed.filter(F.col("_list").isNull()).select(
        *rest, F.lit("EXTRACTION_ERROR").alias("reason"), F.lit("the answer is no JSON array of the expected form").alias("detail"),
        F.col("response").alias("raw_payload"),
    )
    return rows, bad


def extracted_properties(candidates: DataFrame) -> DataFrame:
    """Add ``properties``: the name first, then what was extracted over it."""
    named = F.create_map(F.lit("name"), quote(F.col("name")))
    literals = F.transform_values("extracted", lambda k, v: F.to_json(v))
    literals = F.map_filter(literals, lambda k, v: v.isNotNull() & (v != "null"))
    merged = F.when(
        F.col("extracted").isNotNull(),
        F.map_concat(F.map_filter(named, lambda k, v: ~F.map_contains_key(literals, k)), literals),
    ).otherwise(named)
    return candidates.withColumn("properties", merged)
