"""Search semantics over files in memory and in folders."""

import bz2
import gzip
import io
import json
import lzma
import os
import random
import re
import tarfile
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lexgrain import cli
from lexgrain.engine import Engine, search
from lexgrain.errors import IndexCorrupted, IndexMissing, InvalidPattern, UnsupportedVersion, WatcherRunning
from lexgrain.functions.text import is_binary, shown
from lexgrain.operators import index as index_ops
from lexgrain.operators import matching, render
from lexgrain.operators.index import META, StoredIndex
from lexgrain.schema import SOURCE, SearchOptions
from lexgrain.sources.files import expand, list_files, load_files, read_files
from lexgrain.streaming import changes
from lexgrain.streaming.state import WatcherState


def source(spark, files: dict):
    rows = [(i, p, p.rpartition(".")[2], 1, len(b), b) for i, (p, b) in enumerate((p, b if isinstance(b, bytes) else b.encode()) for p, b in files.items())]
    return spark.createDataFrame([(a, b, c, d, e, bytearray(f)) for a, b, c, d, e, f in rows], SOURCE)


def found(spark, files, pattern, **options):
    r = search(source(spark, files), pattern, SearchOptions(**options))
    return sorted((m["path"], m["line_number"], m["col"], m["byte_offset"], m["line_content"]) for m in r.found.collect())


def by_hand(files: dict, hit) -> list:
    """What a search has to find in texts, line by line: hit gives the column (from 0) of a line's first match or -1."""
    out = []
    for path, text in files.items():
        at = 0
        for n, raw in enumerate(text.splitlines(keepends=True), 1):
            k = hit(raw)
            if k >= 0:
                lead = len(raw[:k].encode())
                out.append((path, n, lead + 1, at + lead, raw.rstrip()))
            at += len(raw.encode())
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    """Texts of random words with accents, blank lines and trailing blanks."""
    r = random.Random(12)
    words = ["oak", "elm", "ash-tree", "42", "7", "é", "été", "birch", "Oak"]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 6))) + r.choice(["", " ", "\t"])
    return {f"wood/{i}.{r.choice(['md', 'txt', 'cc', 'cpp'])}": "\n".join(line() for _ in range(r.randint(0, 30))) + r.choice(["", "\n"]) for i in range(12)}


def test_literals_and_patterns(spark, prose):
    ascii_only = dict(include_binary=True)  # accents may make a short text look binary
    for literal in ("oak", "sh-t", "été", "7"):
        assert found(spark, prose, literal, **ascii_only) == by_hand(prose, lambda x, p=literal: x.find(p))
    for pattern in ("[0-9]+ e", "^(oak|elm) ", "b.rch\\b"):
        assert found(spark, prose, pattern, regex=True, **ascii_only) == by_hand(prose, lambda x, p=pattern: m.start() if (m := re.search(p, x)) else -1)
    assert found(spark, prose, "OAK", ignore_case=True, **ascii_only) == by_hand(prose, lambda x: x.lower().find("oak"))
    assert found(spark, {"raw.dat": b"seeds\0and a zero byte\n" * 3}, "zero")[0][:2] == ("raw.dat", 1)


def test_edges(spark):
    assert found(spark, {"e.txt": ""}, "a") == []
    long = "a" * 100_000 + "pattern" + "b" * 100_000
    assert found(spark, {"l.txt": long}, "pattern")[0][1:4] == (1, 100_001, 100_000)
    assert len(found(spark, {"t.txt": "pattern 1 pattern 2"}, "pattern")) == 1
    assert found(spark, {"z.bin": b"\0" * 1000}, "pattern") == []
    assert found(spark, {"c.txt": "line1\r\nmatch\r\n"}, "match") == [("c.txt", 2, 1, 7, "match")]
    assert found(spark, {"u.txt": "é foo  \t\n"}, "foo") == [("u.txt", 1, 4, 3, "é foo")]
    assert found(spark, {"t.txt": "foo\n"}, "foo$", regex=True) == [] and len(found(spark, {"t.txt": "x\nfoo"}, "foo$", regex=True)) == 1
    assert found(spark, {"bad.txt": b"good line\n\xff\xfe bad\n"}, "good") == []
    cyrillic = {"c.txt": "привет мир\n"}
    assert found(spark, cyrillic, "мир") == [] and len(found(spark, cyrillic, "мир", include_binary=True)) == 1
    assert found(spark, {"r.txt": "a\rb\n"}, "a.b", regex=True) != []
    assert len(found(spark, {"k.txt": "K and ſ\n"}, "k", ignore_case=True, include_binary=True)) == 1
    with pytest.raises(InvalidPattern):
        found(spark, {"a.txt": "x"}, "(", regex=True)


def test_sizes_and_repeats(spark):
    tiny = {n: "abcd"[:i] for i, n in enumerate(["zero.txt", "one.txt", "two.txt", "three.txt", "four.txt"])}
    assert [m[0] for m in found(spark, tiny, "abc")] == ["four.txt", "three.txt"]
    many = {"m.txt": "abc\n" * 1000}
    assert len(found(spark, many, "abc", max_results=100)) == 100 and len(found(spark, many, "abc")) == 1000
    r = search(source(spark, many), "abc", SearchOptions(max_results=100))
    assert r.stats().first()["total_matches"] == 100 and r.capped()


def test_large_file(spark):
    line = "a line like any other with one pattern in it.\n"
    big = source(spark, {"big.txt": line * (10 * 2**20 // len(line))})
    r = search(big, "pattern", SearchOptions(max_results=10))
    assert r.found.count() == 10 and r.stats().first()["files_verified"] == 1
    n = 10 * 2**20 // len(line)
    last = search(big, "pattern").found.orderBy("line_number", ascending=False).first()
    assert (last["line_number"], last["byte_offset"]) == (n, (n - 1) * len(line) + line.index("pattern"))
    lines = matching.all_lines(search(big, "a").verified).orderBy("line_number", ascending=False).first()
    assert (lines["line_number"], lines["byte_offset"]) == (n, (n - 1) * len(line))


def test_context(spark, prose):
    for n in (1, 3):
        got = search(source(spark, prose), "elm", SearchOptions(context=n, include_binary=True)).found
        want = {}
        for path, text in prose.items():
            lines = [x.rstrip() for x in text.splitlines()]
            for i, x in enumerate(lines):
                if "elm" in x:
                    want[path, i + 1] = (lines[max(0, i - n) : i], lines[i + 1 : i + 1 + n])
        assert {(r["path"], r["line_number"]): (r["context_before"], r["context_after"]) for r in got.collect()} == want
        shown = {(p, k) for p, i in want for k in range(max(1, i - n), min(len(prose[p].splitlines()), i + n) + 1)}
        blocks = matching.blocks(matching.with_context_lines(got, n)).collect()
        assert {(r["path"], r["line_number"]) for r in blocks} == shown and len(blocks) == len(shown)
        for r in blocks:  # a block goes on where the line before is shown too
            assert r["block"] == sum((r["path"], k) in shown and (r["path"], k - 1) not in shown for k in range(1, r["line_number"] + 1))


def test_types_prefix_multiline(spark):
    tree = {f"{d}/{n}.{e}": f"a {n} here\n" for d in ("lib", "lib2", "lib/in") for n in ("x", "y") for e in ("cc", "cpp", "md")}
    paths = lambda **o: {m[0] for m in found(spark, tree, "here", **o)}
    assert paths(types=("md",)) == {p for p in tree if p.endswith(".md")} and paths(types=("cpp", "md")) == set(tree)  # one name for several extensions
    assert paths(path_prefix="lib") == {p for p in tree if p.startswith("lib/")} and paths(path_prefix="lib/in/") == {p for p in tree if p.startswith("lib/in/")}
    assert paths(path_prefix="lib2", max_results=2) == {"lib2/x.cc", "lib2/x.cpp"}  # filtered before limited
    lines = {"a.txt": "one\ntwo\nthree"}
    assert found(spark, lines, "one.two", regex=True, multiline="line") == []
    assert found(spark, lines, "wo.three", regex=True, multiline="document")[0][1:4] == (2, 2, 5)


def test_render(spark):
    f = search(source(spark, {"q\"\\.txt": "say \"hi\" \\ there " + "é" * 150}), "hi", SearchOptions(include_binary=True)).found
    row = json.loads(render.jsonl(f).first()["value"])
    assert row["file"] == 'q"\\.txt' and row["content"].endswith("...") and row["byte_offset"] == 5
    assert len(row["content"][:-3].encode()) in (199, 200)
    assert render.grep(f).first()["value"].startswith('q"\\.txt:1:5:say')
    cut = spark.createDataFrame([("é" * 101,), ("a" * 200,), ("a" * 199 + "é",)], "s string").select(shown(__import__("pyspark.sql.functions", fromlist=["col"]).col("s")).alias("s"))
    assert [r["s"] for r in cut.collect()] == ["é" * 100 + "...", "a" * 200, "a" * 199 + "..."]
    none = search(source(spark, {"a.txt": "x"}), "zzz").found
    assert matching.count(none).first()["count"] == 0 and json.loads(render.files_json(matching.files_with_matches(none)).first()["value"]) == {"files": []}


def test_binary(spark):
    rows = spark.createDataFrame([(bytearray(b),) for b in (b"", b"a" * 70 + b"\0" * 30, b"a" * 69 + b"\0" * 31, b"\t\r\n ~", b"a" * 512 + b"\0" * 999)], "c binary")
    assert [r["b"] for r in rows.select(is_binary(rows.c).alias("b")).collect()] == [False, False, True, False, False]


TEXTS = {
    "a.txt": "License under MIT\nfoo bar baz\n", "b.txt": "licensed under GPL\nÉtude étude\n", "c.rs": "let x = 42;\nfn main() { foo(); }\n", "d.txt": "KASK kask Kask\nfoobar",
    "e.txt": "a" * 50 + "\nneedle in hay\n", "f.md": "", "g.txt": "nul\0byte here\n",
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = "file://" + str(tmp_path_factory.mktemp("index"))
    stats = index_ops.build(source(spark, TEXTS), root)
    assert stats == {"files_scanned": 7, "files_skipped_binary": 0, "files_skipped_size": 0, "bytes_scanned": sum(len(x.encode()) for x in TEXTS.values())}
    return root


@pytest.mark.parametrize(("pattern", "options"), [
    ("foo", {}), ("fo", {}), ("licensed", {}), ("LICENSE", {"ignore_case": True}), ("kask", {"ignore_case": True}), ("étude", {"ignore_case": True}), ("l\0b", {}), ("absent text", {}),
    ("licen[sc]ed? under", {"regex": True}), ("foo|needle", {"regex": True}), ("(foo) bar", {"regex": True}), (r"\bfoo\b", {"regex": True}), ("FOO", {"regex": True, "ignore_case": True}), ("x{2}", {"regex": True}),
])
def test_index_finds_what_a_scan_finds(spark, stored, pattern, options):
    o = SearchOptions(**options)
    key = lambda r: sorted(map(tuple, r.found.drop("context_before", "context_after").collect()))
    assert key(search(source(spark, TEXTS), pattern, o, StoredIndex(spark, stored))) == key(search(source(spark, TEXTS), pattern, o))


def test_stored_filters(spark, stored):
    from lexgrain.operators.candidates import candidates
    from lexgrain.plans.planner import plan

    index = StoredIndex(spark, stored)
    assert index.blooms.count() == 7
    for pattern in ("License under MIT", "needle in hay", "fn main() {"):
        want = {r["path"] for r in search(source(spark, TEXTS), pattern).found.collect()}
        ids = {r["file_id"] for r in candidates(plan(pattern), index, filters=True)[0].collect()}
        plain = {r["file_id"] for r in candidates(plan(pattern), index)[0].collect()}
        assert ids <= plain and want == {r["path"] for r in index.files.collect() if r["file_id"] in ids}


def test_stats(spark, stored):
    s = search(source(spark, TEXTS), "needle", SearchOptions(), StoredIndex(spark, stored)).stats().first()
    assert (s["trigrams_queried"], s["candidate_files"], s["files_verified"], s["total_matches"]) == (4, 1, 1, 1) and s["bytes_verified"] == len(TEXTS["e.txt"])


def tables(spark, root):
    i = StoredIndex(spark, root)
    paths = {r["file_id"]: r["path"] for r in i.files.collect()}
    return sorted((r["trigram"], paths[r["file_id"]], r["tf"]) for r in i.postings.collect()), sorted(map(tuple, i.dictionary.collect())), sorted((r["path"], r["content_hash"], r["trigram_count"]) for r in i.files.collect())


def test_update_equals_rebuild(spark, tmp_path):
    root, again = f"file://{tmp_path}/u", f"file://{tmp_path}/r"
    index_ops.build(source(spark, TEXTS), root)
    assert index_ops.update(source(spark, TEXTS), root) == {"added": 0, "modified": 0, "deleted": 0}
    new = {"0.txt": "first now"} | TEXTS | {"c.rs": "let y = 4300;", "new.txt": "brand new"}
    del new["a.txt"]
    assert index_ops.update(source(spark, new), root) == {"added": 2, "modified": 1, "deleted": 1}
    index_ops.build(source(spark, new), again)
    assert tables(spark, root) == tables(spark, again)
    StoredIndex(spark, root).check()
    assert index_ops.update(source(spark, new), f"file://{tmp_path}/fresh")["added"] == len(new)


def test_expanding_holds_few_contents():
    """A worker holds one content and a small batch of results besides what it was given, and passes on no batch a file."""
    bodies = [random.Random(i).randbytes(20_000) for i in range(1500)]
    n = len(bodies)
    columns = [pa.array(range(n), pa.int64()), pa.array([f"{i}.zst" for i in range(n)]), pa.array(["zst"] * n), pa.array([1] * n, pa.int64()), pa.array([1] * n, pa.int64())]
    given = pa.RecordBatch.from_arrays([*columns, pa.array([zstandard.ZstdCompressor().compress(b) for b in bodies], pa.binary())], names=SOURCE.names)
    work = []

    class Files:
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: work.append(f)

    expand(Files(), decompress=True)
    tracemalloc.start()
    seen = batches = 0
    for out in work[0](iter([given])):
        assert [x.as_py() for x in out.column(5)] == bodies[seen : seen + len(out)]
        seen, batches = seen + len(out), batches + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and batches < n / 20 and peak < 10_000_000


def test_line_starts_of_a_large_batch(spark):
    text = ("x" * 70 + "\n") * 40_000  # more than one step of the search for line ends
    rows = matching.all_lines(source(spark, {"a.txt": "first\n", "b.txt": text, "c.txt": "\n\nlast"}).coalesce(1).withColumn("text", F.decode("content", "UTF-8")))
    got = {(r["path"], r["line_number"]): r["byte_offset"] for r in rows.select("path", "line_number", "byte_offset").collect()}
    assert got == {("a.txt", 1): 0, ("c.txt", 1): 0, ("c.txt", 2): 1, ("c.txt", 3): 2} | {("b.txt", i + 1): 71 * i for i in range(40_000)}


def test_build_uses_all_cores_and_deals_no_posting(spark, tmp_path, monkeypatch):
    files = {f"{i}.txt": f"text number {i} of forty" for i in range(40)} | {"raw.bin": b"\0\1" * 300}
    whole, plans = index_ops._write, []

    def write(*args):
        plans.append(args[4]._jdf.queryExecution().executedPlan().toString())
        return whole(*args)

    monkeypatch.setattr(index_ops, "_write", write)
    monkeypatch.setattr(index_ops, "TOGETHER", 0)  # as if there were many
    spread = source(spark, files).coalesce(1)  # as from a table of one row group
    stats = index_ops.build(spread, f"file://{tmp_path}/i")
    assert stats == {"files_scanned": 41, "files_skipped_binary": 1, "files_skipped_size": 0, "bytes_scanned": sum(map(len, files.values()))}
    assert sum(p.name.endswith(".parquet") for p in (tmp_path / "i/v=1/postings").iterdir()) > 1
    index = StoredIndex(spark, f"file://{tmp_path}/i")
    assert index.postings.count() == index.files.agg({"trigram_count": "sum"}).first()[0] and index.skipped.count() == 1
    assert "Exchange rangepartitioning" not in plans[0]


def test_update_moves_no_posting(spark, tmp_path, monkeypatch):
    """Postings of unchanged files are told apart by a broadcast, however large the tables."""
    files = {f"{i}.txt": f"text number {i} of forty" for i in range(40)}
    index_ops.build(source(spark, files), f"file://{tmp_path}/i")
    whole, plans = index_ops._write, []

    def write(*args):
        plans.append(args[4]._jdf.queryExecution().executedPlan().toString())
        return whole(*args)

    monkeypatch.setattr(index_ops, "_write", write)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = files | {"7.txt": "another text", "8.txt": "a third text"}
        assert index_ops.update(source(spark, new), f"file://{tmp_path}/i") == {"added": 0, "modified": 2, "deleted": 0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert re.search(r"\w+Join", plans[0]).group() == "BroadcastHashJoin"  # the topmost, over the postings
    index_ops.build(source(spark, new), f"file://{tmp_path}/again")
    assert tables(spark, f"file://{tmp_path}/i") == tables(spark, f"file://{tmp_path}/again")


def test_many_candidates_move_no_text(spark, stored, monkeypatch):
    from lexgrain import engine

    monkeypatch.setattr(engine, "FEW", 0)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search(source(spark, TEXTS), "needle", SearchOptions(), StoredIndex(spark, stored)).found
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and [r["path"] for r in found.collect()] == ["e.txt"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_only_candidates_and_changes_are_loaded(spark, tmp_path):
    d = tmp_path / "w"
    d.mkdir()
    for i in range(40):
        (d / f"{i}.txt").write_text(f"text number {i}\nneedle\n" if i % 20 == 0 else f"text number {i}\n")
    loaded = []

    def load(listed):
        loaded.append(sorted(r["path"] for r in listed.collect()))
        return load_files(listed, str(d))

    root = f"file://{tmp_path}/i"
    index_ops.build(load_files(list_files(spark, str(d)), str(d)), root)
    files = list_files(spark, str(d))
    r = search(files, "needle", SearchOptions(), StoredIndex(spark, root), load=load)
    assert r.found.count() == 2 and loaded == [["0.txt", "20.txt"]]
    assert search(files, "needle", SearchOptions(path_prefix="20.txt"), StoredIndex(spark, root), load=load).found.count() == 1 and loaded[1:] == [["20.txt"]]
    assert search(files, "no such text", SearchOptions(), StoredIndex(spark, root), load=load).found.count() == 0 and loaded[2:] == [[]]
    (d / "3.txt").write_text("needle now\n")
    os.utime(d / "3.txt", (4e9, 4e9))
    (d / "new.txt").write_text("needle too\n")
    os.remove(d / "5.txt")
    assert index_ops.update(list_files(spark, str(d)), root, load) == {"added": 1, "modified": 1, "deleted": 1} and loaded[3:] == [["3.txt", "new.txt"]]
    assert sorted(x["path"] for x in search(list_files(spark, str(d)).drop("file_id").join(StoredIndex(spark, root).files.select("file_id", "path"), "path"), "needle", SearchOptions(), StoredIndex(spark, root), load=load).found.collect()) == ["0.txt", "20.txt", "3.txt", "new.txt"]


def test_damaged_postings(spark, tmp_path):
    root = tmp_path / "i"
    index_ops.build(source(spark, TEXTS), f"file://{root}")
    part = next(p for p in (root / "v=1" / "postings").iterdir() if p.name.startswith("part-"))
    data = bytearray(part.read_bytes())
    data[len(data) // 3] ^= 1
    part.write_bytes(bytes(data))
    (part.parent / f".{part.name}.crc").unlink()  # the file system's own checksum is not what finds it
    with pytest.raises(Exception):  # noqa: B017  Spark's own error
        StoredIndex(spark, f"file://{root}").postings.collect()


def test_integrity(spark, tmp_path):
    root = str(tmp_path / "i")
    with pytest.raises(IndexMissing):
        StoredIndex(spark, f"file://{root}")
    index_ops.build(source(spark, TEXTS), f"file://{root}")
    meta = StoredIndex(spark, f"file://{root}").meta.asDict()
    folder = f"file://{root}/v=1/meta"
    for change, error in (({"version_major": 99}, UnsupportedVersion), ({"posting_count": 1}, IndexCorrupted), ({"created_at_us": 1}, IndexCorrupted)):
        spark.createDataFrame([tuple((meta | change).values())], META).write.mode("overwrite").parquet(folder)
        with pytest.raises(error):
            StoredIndex(spark, f"file://{root}")
    os.rename(f"{root}/v=1/postings", f"{root}/v=1/gone")
    with pytest.raises(IndexCorrupted):
        StoredIndex(spark, f"file://{root}")


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "work"
    (d / ".hid").mkdir(parents=True)
    (d / "sub").mkdir()
    (d / "_u.txt").write_text("needle one\n")
    (d / ".hid" / "y.rs").write_text("needle two\n")
    (d / "sub" / "a.txt").write_text("x\nneedle three\n")
    body = b"packed needle\n"
    (d / "a.gz").write_bytes(gzip.compress(body))
    (d / "a.bz2").write_bytes(bz2.compress(body))
    (d / "a.xz").write_bytes(lzma.compress(body))
    (d / "broken.gz").write_bytes(b"no gzip")
    try:
        import zstandard

        (d / "a.zst").write_bytes(zstandard.ZstdCompressor().compress(body))
    except ImportError:
        pass
    with zipfile.ZipFile(d / "z.zip", "w") as z:
        z.writestr("in/side.txt", "zip needle\n")
    with tarfile.open(d / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("side.txt")
        info.size = 11
        t.addfile(info, io.BytesIO(b"tar needle\n"))
    return d


def test_folder(spark, folder):
    e = Engine(spark)
    paths = lambda r: sorted(x["path"] for x in r.found.select("path").collect())
    assert paths(e.search("needle", str(folder))) == [".hid/y.rs", "_u.txt", "sub/a.txt"]
    assert len(paths(e.search("needle", str(folder), SearchOptions(decompress=True)))) >= 6
    assert {"z.zip:in/side.txt", "t.tar.gz:side.txt"} <= set(paths(e.search("needle", str(folder), SearchOptions(archives=True))))
    assert e.build(str(folder))["files_scanned"] >= 3
    assert paths(e.search("needle", str(folder))) == [".hid/y.rs", "_u.txt", "sub/a.txt"]
    assert paths(e.search("needle", str(folder / "sub"))) == ["sub/a.txt"]
    assert not e.stale(str(folder))
    (folder / "new.txt").write_text("needle four\n")
    os.utime(folder / "new.txt", (4e9, 4e9))
    assert e.stale(str(folder))
    assert e.update(str(folder))["added"] == 1 and "new.txt" in paths(e.search("needle", str(folder)))
    WatcherState.new(str(folder)).write(str(folder / ".lexgrain"))
    assert not e.stale(str(folder))
    with pytest.raises(WatcherRunning):
        e.build(str(folder))
    WatcherState.remove(str(folder / ".lexgrain"))
    assert "new.txt" in paths(e.search("needle", str(folder), fresh=True))


def test_size_limit(spark):
    big = source(spark, {"a.txt": "needle"}).withColumn("size_bytes", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(100 * 1024 * 1024 + 1).cast("long"))
    assert index_ops.usable(big).count() == 0 and index_ops.build_stats(big).first()["files_skipped_size"] == 1


def test_stream_text(spark):
    texts = spark.createDataFrame([("(stdin)", "one\r\nfoo\n\nlast foo"), ("none", None)], "path string, text string")
    got = Engine(spark).search_text(texts, "foo$", SearchOptions(regex=True, context=1)).found.collect()
    assert sorted((r["line_number"], r["col"], r["byte_offset"], r["line_content"]) for r in got) == [(2, 1, 0, "foo"), (4, 6, 0, "last foo")]


def run(spark, *args, stdin=None):
    out, err = io.StringIO(), io.StringIO()
    return cli.main(list(args), spark, io.StringIO(stdin) if stdin is not None else None, out, err), out.getvalue(), err.getvalue()


def test_command_line(spark, folder):
    p = str(folder)
    assert run(spark, "needle", p, "-c") == (0, "3\n", "")
    assert run(spark, "needle", p, "-l")[1] == ".hid/y.rs\n_u.txt\nsub/a.txt\n"
    assert json.loads(run(spark, "needle", p, "-l", "--json")[1])["files"] == [".hid/y.rs", "_u.txt", "sub/a.txt"]
    assert run(spark, "three", p)[1] == "sub/a.txt:2:9:needle three\n"
    assert run(spark, "three", p, "-C", "1")[1] == "sub/a.txt:1:- :x\nsub/a.txt:2:9:needle three\n"
    code, out, err = run(spark, "needle", p, "-n", "2", "--stats")
    assert code == 0 and len(out.splitlines()) == 2 and "capped at 2" in err and "total_matches: 2" in err
    assert run(spark, "(", p, "-r")[0] == 1 and run(spark, "a", p, "-U")[0] == 1
    assert run(spark, "zzz", p)[0] == 0
    assert run(spark, "b", "-c", "--json", stdin="a\nb\n")[1] == '{"count":1}\n'
    assert run(spark, "--build", p)[0] == 0 and run(spark, "needle", p, "-c")[1] == "3\n"


def test_expand(spark):
    packed = source(spark, {"a.gz": gzip.compress(b"x needle\n")})
    assert search(expand(packed, decompress=True), "needle").found.count() == 1


def test_debounce_of_dense_times(spark):
    import pyspark.sql.functions as F

    r = random.Random(3)
    times = sorted(r.randrange(0, 8_000) for _ in range(300)) + [20_000_000 + 700 * i for i in range(5)]
    df = spark.createDataFrame([(t, f"p{t % 7}") for t in times], "ms long, path string").withColumn("ts", F.timestamp_millis("ms"))
    want, batch = [], []
    for t in times:
        if batch and t - batch[-1] >= 50:
            want.append(batch)
            batch = []
        batch.append(t)
    want.append(batch)
    for most in (1_000_000, 10):  # as one slice, and as many
        got = changes.debounce(df, F.col("path"), F.col("ts"), silence_ms=50, slice_rows=most).orderBy("batch_start").collect()
        assert [(x["n_events"], x["paths"]) for x in got] == [(len(b), sorted({f"p{t % 7}" for t in b})) for b in want]


def test_streams(spark, tmp_path):
    import pyspark.sql.functions as F

    rows = spark.createDataFrame([(0, "a"), (300, "b"), (700, "a"), (1500, "c")], "ms long, path string").withColumn("ts", F.timestamp_millis("ms"))
    got = changes.debounce(rows, F.col("path"), F.col("ts"), slice_s=1).orderBy("batch_start").collect()
    assert [(r["n_events"], r["paths"]) for r in got] == [(3, ["a", "b"]), (1, ["c"])]
    rows.write.parquet(str(tmp_path / "in"))
    stream = changes.debounce_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), F.col("path"), F.col("ts"), late="0 seconds")
    q = stream.writeStream.format("memory").queryName("batches").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n_events"] for r in spark.table("batches").collect()) == [1, 3]
    root = f"file://{tmp_path}/index"
    log = spark.readStream.schema("ms long, path string, ts timestamp").parquet(str(tmp_path / "in"))
    changes.index_stream(log, lambda: source(spark, TEXTS), root, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert StoredIndex(spark, root).meta["file_count"] == 7


def test_run_watcher(spark, tmp_path):
    (tmp_path / "a.txt").write_text("needle\n")
    folder = str(tmp_path / ".lexgrain")
    w = changes.Watcher(str(tmp_path), poll_s=0.02, silence_ms=100)
    (tmp_path / "b.txt").write_text("needle\n")
    changes.run_watcher(spark, str(tmp_path), folder, w, rounds=1)
    assert StoredIndex(spark, f"file://{folder}/index").meta["file_count"] == 2 and WatcherState.read(folder) is None


def test_watcher_ends_on_sigterm(spark, tmp_path):
    import signal
    import threading

    (tmp_path / "a.txt").write_text("needle\n")
    folder = str(tmp_path / ".lexgrain")
    before = signal.getsignal(signal.SIGTERM)
    threading.Timer(3.0, lambda: os.kill(os.getpid(), signal.SIGTERM)).start()
    changes.run_watcher(spark, str(tmp_path), folder, changes.Watcher(str(tmp_path), poll_s=0.02))
    assert WatcherState.read(folder) is None and signal.getsignal(signal.SIGTERM) == before


def test_stale_warning(spark, folder):
    assert run(spark, "--build", str(folder))[0] == 0
    assert run(spark, "needle", str(folder), "-c") == (0, "3\n", "")
    (folder / "late.txt").write_text("other\n")
    os.utime(folder / "late.txt", (4e9, 4e9))
    assert "files changed since the index was built at 20" in run(spark, "needle", str(folder), "-c")[2]
    assert run(spark, "needle", str(folder), "-c", "--fresh")[2] == ""


def test_read_only_paths(spark, folder):
    assert read_files(spark, str(folder), paths=["_u.txt"]).count() == 1
