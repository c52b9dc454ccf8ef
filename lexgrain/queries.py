"""Queries over the test tables, one for each operator, and their SQL. A row with a text is a file."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import tarfile
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import search
from .functions import trigrams as tri
from .functions.text import is_binary, lines, shown, trim_end
from .operators import candidates as cand
from .operators import index as index_ops
from .operators import matching, render
from .operators.index import StoredIndex
from .plans.planner import CaseInsensitive, plan
from .schema import MAX_FILE_BYTES, SOURCE, SearchOptions
from .sources import tables
from .sources.files import expand
from .streaming import changes
from .streaming.state import idle_state_column

Query = Callable[[SparkSession, str], DataFrame]

LITERAL, RARE, REGEX, ANCHORED, FOLDED = "tion and", "license", "[0-9]{3}", "^The [a-z]+ ", "LICENSE"
FRAGMENTS = "license[sd]? under"
PLACE = ("path", "line_number", "col", "line_content", "byte_offset")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session has one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexgrain-")
    return folder.rstrip("/")


_BUILT: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The documents' index, built once a session and folder: it pays by being used again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        root = f"{_scratch(spark)}/index-{hashlib.md5(sf_dir.encode()).hexdigest()}"
        index_ops.build(_docs(spark, sf_dir).select(*SOURCE.names), root)
        _BUILT[key] = root
    return StoredIndex(spark, _BUILT[key], check=False)


def _scan(pattern: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(_text(spark, sf_dir), pattern, SearchOptions(**options)).found.select(*PLACE)

    return query


def _indexed(pattern: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the index has no binary files
        return search(_docs(spark, sf_dir).drop("content"), pattern, SearchOptions(**options), _index(spark, sf_dir)).found.select(*PLACE)

    return query


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(~is_binary(F.col("content"))).drop("content")


def _found(spark: SparkSession, sf_dir: str, pattern: str = LITERAL, **options) -> DataFrame:
    return search(_text(spark, sf_dir), pattern, SearchOptions(**options)).found


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.all_lines(_docs(spark, sf_dir)).select("path", "line_number", "line_content", "byte_offset")


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = [F.array_join(c, "\n").alias(c) for c in ("context_before", "context_after")]
    return _found(spark, sf_dir, context=2).select("path", "line_number", *joined)


def context_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.with_context_lines(_found(spark, sf_dir, context=1), 1).withColumn("byte_offset", F.coalesce("byte_offset", F.lit(-1)))


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.blocks(context_merged(spark, sf_dir)).select("path", "line_number", "is_match", "block")


def render_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.grep(_found(spark, sf_dir))


def render_grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.grep_context(_found(spark, sf_dir, context=1), 1)


def render_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.jsonl(_found(spark, sf_dir, RARE, context=1))


def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.count(_found(spark, sf_dir, count_only=True))


def count_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.count_json(count_matches(spark, sf_dir))


def count_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.count_by_file(_found(spark, sf_dir, count_only=True))


def files_with_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.files_with_matches(_found(spark, sf_dir))


def files_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.files_json(matching.files_with_matches(_found(spark, sf_dir, RARE)))


def max_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the first 100 matches in (path, line_number) order."""
    return search(_text(spark, sf_dir), LITERAL, SearchOptions(max_results=100)).found.select(*PLACE)


def truncated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("path", F.posexplode(lines(F.col("text"))).alias("i", "raw"))
    return rows.select("path", (F.col("i") + 1).alias("line_number"), shown(trim_end(F.col("raw"))).alias("shown"))


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_ops.file_table(_docs(spark, sf_dir)).select("file_id", "path", "ext", "size_bytes", "content_hash", "is_binary", "status")


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_ops.build_stats(_docs(spark, sf_dir))


def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tri.postings(_docs(spark, sf_dir))


def trigram_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tri.postings(_docs(spark, sf_dir), offsets=True).select("trigram", "file_id", F.array_join("offsets", ",").alias("offsets"))


def trigram_doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).dictionary


def candidates_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cand.division(_index(spark, sf_dir).postings, list(plan(RARE).trigrams))


def candidates_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(FRAGMENTS, regex=True)
    return cand.division(_index(spark, sf_dir).postings, [t for s in p.trigram_sets for t in s])


def candidates_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(FOLDED, ignore_case=True)
    assert isinstance(p, CaseInsensitive)
    return cand.grouped(_index(spark, sf_dir).postings, list(p.groups))


def bloom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose filter may hold all trigrams of a string, and that do: a filter denies none of them."""
    grams, docs = list(plan(RARE).trigrams), _docs(spark, sf_dir)
    return cand.division(tri.postings(docs), grams).join(tri.may_contain(tri.blooms(docs), grams), "file_id", "left_semi")


def bloom_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with the stored filters asked for the trigrams whose lists aren't read."""
    return search(_docs(spark, sf_dir).drop("content"), RARE, SearchOptions(), _index(spark, sf_dir), filters=True).found.select(*PLACE)


def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_text(spark, sf_dir), RARE, SearchOptions(), _index(spark, sf_dir)).stats()


def _snapshot(docs: DataFrame) -> DataFrame:
    """How the files stood before: some not there yet, some with another text, some that are gone now."""
    old = docs.where("file_id % 5 <> 1")
    body = F.when(F.col("file_id") % 7 == 2, F.concat(F.lit("before "), "text")).otherwise(F.col("text"))
    gone = docs.where("file_id % 11 = 3").withColumns({"file_id": F.col("file_id") + 100_000_000_000, "path": F.concat(F.lit("gone/"), "path")})
    rows = old.withColumn("text", body).unionByName(gone)
    return rows.withColumns({"content": F.encode("text", "UTF-8"), "size_bytes": F.octet_length("text").cast("long")})


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc frequencies after updating the index of an older snapshot: those of a rebuild."""
    docs = _docs(spark, sf_dir)
    root = f"{_scratch(spark)}/update-{hashlib.md5(f'{sf_dir}{id(docs)}'.encode()).hexdigest()}"
    index_ops.build(_snapshot(docs).select(*SOURCE.names), root)
    index_ops.update(docs.select(*SOURCE.names), root)
    return StoredIndex(spark, root).dictionary


def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return index_ops.diff(docs, _snapshot(docs))


def _squeezed(ext: str, packed: Callable[[bytes], bytes]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for i in range(0, len(whole), 256):
                    b = whole.slice(i, 256)
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([packed(x.as_py()) for x in b.column(5)], pa.binary())], names=b.schema.names)

        files = _docs(spark, sf_dir).select(*SOURCE.names).withColumns({"path": F.concat("path", F.lit(f".{ext}")), "ext": F.lit(ext.rpartition(".")[2])}).mapInArrow(squeeze, SOURCE)
        return search(expand(files, decompress=True, archives=ext in ("zip", "tar.gz")), LITERAL).found.select(*PLACE)

    return query


def _zipped(data: bytes) -> bytes:
    with zipfile.ZipFile(buf := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/text.txt", data)
    return buf.getvalue()


def _tarred(data: bytes) -> bytes:
    with tarfile.open(fileobj=(buf := io.BytesIO()), mode="w:gz", compresslevel=1) as t:
        info = tarfile.TarInfo("in/text.txt")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def _zst(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


def scan_dot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dot that also matches the line's end."""
    return _found(spark, sf_dir, r"and\..", regex=True, multiline="line").select(*PLACE)


def filter_type_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type that stands for several extensions."""
    ext = F.when(F.col("ext") == "en", "cc").when(F.col("ext") == "fr", "cpp").when(F.col("ext") == "de", "h").otherwise(F.col("ext"))
    return search(_text(spark, sf_dir).withColumn("ext", ext), LITERAL, SearchOptions(types=("cpp",))).found.select(*PLACE)


def scan_with_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_docs(spark, sf_dir).drop("text"), LITERAL, SearchOptions(include_binary=True)).found.select(*PLACE)


def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build skips when a few files are recorded as too large."""
    large = F.when(F.col("file_id") % 9 == 4, F.lit(MAX_FILE_BYTES + 1)).otherwise(F.col("size_bytes"))
    return index_ops.build_stats(_docs(spark, sf_dir).withColumn("size_bytes", large.cast("long"))).drop("bytes_scanned")


def multiline_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, r"and\.\n[A-Z]", regex=True, multiline="document").select("path", "line_number", "col", "byte_offset")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(tables.pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("text"), "<a href").found.select(*PLACE)


def stream_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = tables.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("content")
    return search(texts, r"tion\.$", SearchOptions(regex=True, stream=True)).found.select(*PLACE)


def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as a stream over what is there now, written as Parquet."""
    at = f"{_scratch(spark)}/stream-{hashlib.md5(f'{sf_dir}{id(spark)}'.encode()).hexdigest()}-{len(_STREAMS)}"
    _STREAMS.append(at)
    path = f"{sf_dir}/documents.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    fs, p = index_ops.file_system(spark, path)
    if fs.getFileStatus(p).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", "documents.parquet"), sf_dir
    files = tables.documents(reader.parquet(path)).drop("content")
    found = changes.search_stream(files, plan(RARE), SearchOptions()).select(*PLACE)
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out")


_STREAMS: list[str] = []


def _time(ts: str) -> Column:
    """A time without zone as the instant it names in UTC."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(ts).cast("timestamp_ntz")).cast("timestamp")


def debounce_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = changes.debounce(events, F.col("user_id").cast("string"), _time("ts"), silence_ms=60_000)
    return out.select(F.unix_micros("batch_start").alias("start_us"), F.unix_micros("batch_end").alias("end_us"), "n_events", F.array_join("paths", ",").alias("paths"))


def idle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.groupBy("user_id").agg(F.max(F.unix_micros(_time("ts"))).alias("last"))
    now = events.agg(F.max(F.unix_micros(_time("ts"))).alias("now"))
    silent = ((F.col("now") - F.col("last")) / 1_000_000).cast("double")
    return last.crossJoin(now).select("user_id", idle_state_column(silent).alias("state"))  # one row on the right


QUERIES: dict[str, Query] = {
    "scan_literal": _scan(LITERAL),
    "scan_short_literal": _scan("Th"),
    "scan_regex": _scan(REGEX, regex=True),
    "scan_anchored": _scan(ANCHORED, regex=True),
    "scan_ignore_case": _scan(FOLDED, ignore_case=True),
    "scan_regex_ignore_case": _scan("licen[sc]e", regex=True, ignore_case=True),
    "filter_type": _scan(LITERAL, types=("en", "de")),
    "filter_path_prefix": _scan(LITERAL, path_prefix="src1"),
    "index_search_literal": _indexed(RARE),
    "index_search_regex": _indexed(FRAGMENTS, regex=True),
    "index_search_ignore_case": _indexed(FOLDED, ignore_case=True),
    "index_full_scan": _indexed("Th"),
    "decompress_search": _squeezed("gz", gzip.compress),
    "decompress_bz2": _squeezed("bz2", bz2.compress),
    "decompress_xz": _squeezed("xz", partial(lzma.compress, preset=0)),
    "decompress_zst": _squeezed("zst", _zst),
    "archive_search": _squeezed("zip", _zipped),
    "archive_tar": _squeezed("tar.gz", _tarred),
} | {f.__name__: f for f in (
    line_offsets, context_lines, context_merged, context_blocks, render_grep, render_grep_context, render_jsonl, count_matches, count_json, count_by_file, files_with_matches, files_json,
    max_results, truncated_lines, file_table, build_stats, trigram_postings, trigram_offsets, trigram_doc_frequency, candidates_literal, candidates_regex, candidates_ignore_case,
    bloom_candidates, bloom_stored, query_stats, index_update, stale_files, multiline_document, scan_dot_all, filter_type_alias, scan_with_binary, size_limit, scan_pages, stream_mode, stream_search, debounce_batches, idle_state,
)}

# --- SQL -------------------------------------------------------------------------------

_FILES = """all_files AS (
  SELECT doc_id AS file_id, coalesce(source, 'none') || '/' || doc_id || '.' || coalesce(lang, 'txt') AS path, coalesce(lang, 'txt') AS ext, coalesce(text, '') AS text FROM documents
), marked AS (
  SELECT *, substr(hex(encode(text)), 1, 1024) AS head FROM all_files
), files AS (
  SELECT *, length(regexp_replace(head, '09|0A|0D|[2-6].|7[0-9A-E]|(..)', '\\1', 'g')) * 10 > length(head) * 3 AS is_binary FROM marked
)"""
_SPLIT = "regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')"


def _lines(where: str = "NOT is_binary") -> str:
    return f"""{_FILES}, raw_lines AS (
  SELECT file_id, path, ext, unnest({_SPLIT}) AS raw, generate_subscripts({_SPLIT}, 1) AS n FROM files WHERE {where}
), lines AS (
  SELECT file_id, path, ext, n::INT AS line_number, raw, regexp_replace(raw, '\\s+$', '') AS line_content,
    coalesce(sum(strlen(raw)) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_off FROM raw_lines
)"""


def _found_sql(hit: str, lead: str, where: str = "true", scope: str = "NOT is_binary") -> str:
    return f"WITH {_lines(scope)}, found AS (SELECT path, line_number, (strlen({lead}) + 1)::INT AS col, line_content, (line_off + strlen({lead}))::BIGINT AS byte_offset FROM lines WHERE {hit} AND {where})"


def _literal_sql(text: str, where: str = "true", scope: str = "NOT is_binary") -> str:
    return _found_sql(f"contains(raw, '{text}')", f"split_part(raw, '{text}', 1)", where, scope)


def _regex_sql(pattern: str) -> str:
    return _found_sql(f"regexp_matches(raw, '{pattern}')", f"regexp_extract(raw, '(?s)^(.*?)(?-s:{pattern.removeprefix('^')})', 1)" if not pattern.startswith("^") else "''")


_ALL = " SELECT * FROM found"
_GRAMS = """chunks AS (
  SELECT file_id, 100 * j AS base, substr(h, 200 * j + 1, 204) AS c
  FROM (SELECT file_id, hex(encode(text)) AS h, unnest(range(0, (strlen(text) + 99) // 100)) AS j FROM files WHERE NOT is_binary)
), grams AS (
  SELECT file_id, base + i - 1 AS off, ('0x' || substr(c, 2 * i - 1, 6))::INT AS trigram
  FROM (SELECT *, unnest(range(1, strlen(c) // 2 - 1)) AS i FROM chunks)
  WHERE substr(c, 2 * i - 1, 2) <> '00' AND substr(c, 2 * i + 1, 2) <> '00' AND substr(c, 2 * i + 3, 2) <> '00'
)"""
_ANY_GRAMS = _GRAMS.replace(" WHERE NOT is_binary", "")
_DF = f"WITH {_FILES}, {_GRAMS} SELECT trigram, count(DISTINCT file_id) AS doc_frequency FROM grams GROUP BY trigram"


def _division_sql(grams: list[int]) -> str:
    return f"WITH {_FILES}, {_GRAMS} SELECT file_id FROM grams WHERE trigram IN ({', '.join(map(str, grams))}) GROUP BY file_id HAVING count(DISTINCT trigram) = {len(set(grams))}"


def _groups_sql(groups: list[tuple[int, ...]]) -> str:
    values = ", ".join(f"({t}, {g})" for g, group in enumerate(groups) for t in group)
    return f"WITH {_FILES}, {_GRAMS}, want(trigram, grp) AS (VALUES {values}) SELECT file_id FROM grams JOIN want USING (trigram) GROUP BY file_id HAVING count(DISTINCT grp) = {len(groups)}"


_CONTEXT = _lines() + f""", hits AS (SELECT *, contains(raw, '{LITERAL}') AS hit, (line_off + strlen(split_part(raw, '{LITERAL}', 1)))::BIGINT AS pos FROM lines),
near AS (SELECT *, bool_or(hit) OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS shown FROM hits),
merged AS (SELECT path, line_number, CASE WHEN hit THEN pos END AS byte_offset, line_content, hit AS is_match FROM near WHERE shown),
gaps AS (SELECT *, line_number - coalesce(lag(line_number) OVER (PARTITION BY path ORDER BY line_number), -1) > 1 AS gap FROM merged),
blocks AS (SELECT *, sum(gap::INT) OVER (PARTITION BY path ORDER BY line_number)::INT AS block FROM gaps)"""
_CUT = "CASE WHEN strlen({0}) > 200 THEN left({0}, (SELECT max(k)::INT FROM range(50, 201) t(k) WHERE strlen(left({0}, k::INT)) <= 200)) || '...' ELSE {0} END"
_RARE_SQL = _literal_sql(RARE)

SQL: dict[str, str] = {
    "scan_literal": _literal_sql(LITERAL) + _ALL,
    "scan_short_literal": _literal_sql("Th") + _ALL,
    "scan_regex": _regex_sql(REGEX) + _ALL,
    "scan_anchored": _regex_sql(ANCHORED) + _ALL,
    "scan_ignore_case": _found_sql(f"contains(lower(raw), '{FOLDED.lower()}')", f"split_part(lower(raw), '{FOLDED.lower()}', 1)") + _ALL,
    "scan_regex_ignore_case": _found_sql("regexp_matches(raw, '(?i)licen[sc]e')", "regexp_extract(raw, '(?is)^(.*?)licen[sc]e', 1)") + _ALL,
    "filter_type": _literal_sql(LITERAL, "ext IN ('en', 'de')") + _ALL,
    "filter_path_prefix": _literal_sql(LITERAL, "starts_with(path, 'src1/')") + _ALL,
    "index_search_literal": _RARE_SQL + _ALL,
    "index_search_regex": _regex_sql(FRAGMENTS) + _ALL,
    "index_search_ignore_case": _found_sql(f"contains(lower(raw), '{FOLDED.lower()}')", f"split_part(lower(raw), '{FOLDED.lower()}', 1)") + _ALL,
    "index_full_scan": _literal_sql("Th") + _ALL,
    "stream_search": _literal_sql(RARE, scope="true") + _ALL,
    "line_offsets": f"WITH {_lines('true')} SELECT path, line_number, line_content, line_off AS byte_offset FROM lines",
    "context_lines": f"""WITH {_lines()}, w AS (
  SELECT *, coalesce(string_agg(line_content, chr(10)) OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context_before,
    coalesce(string_agg(line_content, chr(10)) OVER (PARTITION BY file_id ORDER BY line_number ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS context_after FROM lines)
SELECT path, line_number, context_before, context_after FROM w WHERE contains(raw, '{LITERAL}')""",
    "context_merged": f"WITH {_CONTEXT} SELECT path, line_number, coalesce(byte_offset, -1) AS byte_offset, line_content, is_match FROM merged",
    "context_blocks": f"WITH {_CONTEXT} SELECT path, line_number, is_match, block FROM blocks",
    "render_grep": f"{_literal_sql(LITERAL)} SELECT path || ':' || line_number || ':' || byte_offset || ':' || {_CUT.format('line_content')} AS value FROM found",
    "render_grep_context": f"WITH {_CONTEXT} SELECT path, line_number, block, path || ':' || line_number || ':' || coalesce(byte_offset::VARCHAR, '- ') || ':' || {_CUT.format('line_content')} AS value FROM blocks",
    "count_matches": f"{_literal_sql(LITERAL)} SELECT count(*) AS count FROM found",
    "count_json": f"{_literal_sql(LITERAL)} SELECT '{{\"count\":' || count(*) || '}}' AS value FROM found",
    "count_by_file": f"{_literal_sql(LITERAL)} SELECT path, count(*) AS count FROM found GROUP BY path",
    "files_with_matches": f"{_literal_sql(LITERAL)} SELECT DISTINCT path FROM found",
    "files_json": f"{_RARE_SQL} SELECT '{{\"files\":[' || coalesce(string_agg('\"' || path || '\"', ',' ORDER BY path), '') || ']}}' AS value FROM (SELECT DISTINCT path FROM found)",
    "max_results": f"{_literal_sql(LITERAL)} SELECT * FROM found ORDER BY path, line_number LIMIT 100",
    "render_jsonl": f"""WITH {_lines()}, w AS (
  SELECT *, lag(line_content) OVER f AS b, lead(line_content) OVER f AS a FROM lines WINDOW f AS (PARTITION BY file_id ORDER BY line_number)
), c AS (
  SELECT path, line_number, (strlen(split_part(raw, '{RARE}', 1)) + 1)::INT AS col, line_off + strlen(split_part(raw, '{RARE}', 1)) AS pos, {_CUT.format('line_content')} AS t,
    CASE WHEN b IS NULL THEN '[]' ELSE '[' || to_json({_CUT.format('b')}) || ']' END AS b, CASE WHEN a IS NULL THEN '[]' ELSE '[' || to_json({_CUT.format('a')}) || ']' END AS a
  FROM w WHERE contains(raw, '{RARE}'))
SELECT '{{"file":' || to_json(path) || ',"line":' || line_number || ',"col":' || col || ',"content":' || to_json(t) || ',"byte_offset":' || pos || ',"context_before":' || b || ',"context_after":' || a || ',"is_binary":false}}' AS value FROM c""",
    "truncated_lines": f"WITH {_lines('true')} SELECT path, line_number, {_CUT.format('line_content')} AS shown FROM lines",
    "file_table": f"WITH {_FILES} SELECT file_id, path, ext, strlen(text)::BIGINT AS size_bytes, md5(text) AS content_hash, is_binary, 'fresh' AS status FROM files",
    "build_stats": f"WITH {_FILES} SELECT count(*) AS files_scanned, count(*) FILTER (is_binary) AS files_skipped_binary, 0::BIGINT AS files_skipped_size, sum(strlen(text))::BIGINT AS bytes_scanned FROM files",
    "trigram_postings": f"WITH {_FILES}, {_ANY_GRAMS} SELECT trigram, file_id, count(*)::INT AS tf FROM grams GROUP BY trigram, file_id",
    "trigram_offsets": f"WITH {_FILES}, {_ANY_GRAMS} SELECT trigram, file_id, string_agg(off::VARCHAR, ',' ORDER BY off) AS offsets FROM grams GROUP BY trigram, file_id",
    "trigram_doc_frequency": _DF,
    "index_update": _DF,
    "candidates_literal": _division_sql(list(plan(RARE).trigrams)),
    "candidates_regex": _division_sql([t for s in plan(FRAGMENTS, regex=True).trigram_sets for t in s]),
    "candidates_ignore_case": _groups_sql(list(plan(FOLDED, ignore_case=True).groups)),
    "query_stats": f"""WITH {_lines()}, {_GRAMS}, df AS (SELECT trigram, count(DISTINCT file_id) AS df FROM grams WHERE trigram IN ({', '.join(map(str, plan(RARE).trigrams))}) GROUP BY trigram),
rare AS (SELECT trigram FROM df ORDER BY df, trigram LIMIT 3), cand AS (SELECT file_id FROM grams WHERE trigram IN (SELECT trigram FROM rare) GROUP BY file_id HAVING count(DISTINCT trigram) = 3)
SELECT {len(plan(RARE).trigrams)}::BIGINT AS trigrams_queried, 3::BIGINT AS posting_lists_decoded, (SELECT count(*) FROM cand) AS candidate_files, (SELECT count(*) FROM cand) AS files_verified,
  (SELECT sum(strlen(text))::BIGINT FROM files WHERE file_id IN (SELECT file_id FROM cand)) AS bytes_verified, (SELECT count(*) FROM lines WHERE contains(raw, '{RARE}')) AS total_matches""",
    "stale_files": f"""WITH {_FILES} SELECT path, CASE WHEN file_id % 5 = 1 THEN 'added' ELSE 'modified' END AS change FROM files WHERE file_id % 5 = 1 OR file_id % 7 = 2
UNION ALL SELECT 'gone/' || path, 'deleted' FROM files WHERE file_id % 11 = 3""",
    "decompress_search": f"{_literal_sql(LITERAL)} SELECT path || '.gz' AS path, line_number, col, line_content, byte_offset FROM found",
    "archive_search": f"{_literal_sql(LITERAL)} SELECT path || '.zip:in/text.txt' AS path, line_number, col, line_content, byte_offset FROM found",
    **{name: f"{_literal_sql(LITERAL)} SELECT path || '.{ext}' AS path, line_number, col, line_content, byte_offset FROM found" for name, ext in (("decompress_bz2", "bz2"), ("decompress_xz", "xz"), ("decompress_zst", "zst"))},
    "archive_tar": f"{_literal_sql(LITERAL)} SELECT path || '.tar.gz:in/text.txt' AS path, line_number, col, line_content, byte_offset FROM found",
    "scan_dot_all": _found_sql("regexp_matches(raw, 'and\\.(?s:.)')", "regexp_extract(raw, '(?s)^(.*?)and\\..', 1)") + _ALL,
    "filter_type_alias": _literal_sql(LITERAL, "ext IN ('en', 'fr')") + _ALL,
    "scan_with_binary": _literal_sql(LITERAL, scope="true") + _ALL,
    "size_limit": f"WITH {_FILES} SELECT count(*) AS files_scanned, count(*) FILTER (is_binary AND file_id % 9 <> 4) AS files_skipped_binary, count(*) FILTER (file_id % 9 = 4) AS files_skipped_size FROM files",
    "bloom_candidates": _division_sql(list(plan(RARE).trigrams)).replace(" WHERE NOT is_binary", ""),
    "bloom_stored": _RARE_SQL + _ALL,
    "multiline_document": f"""WITH {_FILES}, m AS (SELECT path, regexp_extract(text, '(?s)^(.*?)and\\.\\n[A-Z]', 1) AS head FROM files WHERE NOT is_binary AND regexp_matches(text, 'and\\.\\n[A-Z]'))
SELECT path, (1 + length(head) - length(replace(head, chr(10), '')))::INT AS line_number, (strlen(regexp_extract(head, '[^\\n]*$')) + 1)::INT AS col, strlen(head)::BIGINT AS byte_offset FROM m""",
    "scan_pages": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, substr(hex(encode(coalesce(html, ''))), 1, 1024) AS head FROM pages),
r AS (SELECT page_id, url, unnest(regexp_extract_all(html, '[^\\n]*\\n|[^\\n]+')) AS raw, generate_subscripts(regexp_extract_all(html, '[^\\n]*\\n|[^\\n]+'), 1) AS n FROM p
  WHERE NOT length(regexp_replace(head, '09|0A|0D|[2-6].|7[0-9A-E]|(..)', '\\1', 'g')) * 10 > length(head) * 3),
l AS (SELECT *, coalesce(sum(strlen(raw)) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
SELECT url AS path, n::INT AS line_number, (strlen(split_part(raw, '<a href', 1)) + 1)::INT AS col, regexp_replace(raw, '\\s+$', '') AS line_content, (pos + strlen(split_part(raw, '<a href', 1)))::BIGINT AS byte_offset
FROM l WHERE contains(raw, '<a href')""",
    "stream_mode": """WITH r AS (SELECT conv_id || '#' || turn AS path, unnest(regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+')) AS raw,
  generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+'), 1) AS n FROM conversations), l AS (SELECT path, n, regexp_replace(raw, '\\r?\\n$', '') AS line FROM r)
SELECT path, n::INT AS line_number, (strlen(regexp_extract(line, '^(.*?)tion\\.$', 1)) + 1)::INT AS col, line AS line_content, 0::BIGINT AS byte_offset FROM l WHERE regexp_matches(line, 'tion\\.$')""",
    "debounce_batches": """WITH e AS (SELECT user_id::VARCHAR AS path, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
g AS (SELECT *, us - lag(us) OVER (ORDER BY us) >= 60000000 AS gap FROM e), b AS (SELECT path, us, sum(coalesce(gap, true)::INT) OVER (ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS batch FROM g)
SELECT min(us) AS start_us, max(us) AS end_us, count(*) AS n_events, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM b GROUP BY batch""",
    "idle_state": """WITH l AS (SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY user_id), n AS (SELECT max(epoch_us(ts)) AS now FROM events)
SELECT user_id, CASE WHEN (now - last) / 1e6 < 300 THEN 'active' WHEN (now - last) / 1e6 < 1800 THEN 'idle' ELSE 'dormant' END AS state FROM l, n""",
}
