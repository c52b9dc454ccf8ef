"""What needs no Spark: dialect, planner, trigrams, ignore rules, watcher state."""

import os
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrain.errors import InvalidOptions, InvalidPattern
from lexgrain.functions import dialect
from lexgrain.functions import trigrams as t
from lexgrain.plans.planner import CaseInsensitive, FullScan, Literal, RegexWithLiterals, plan
from lexgrain.schema import SearchOptions, expand_types
from lexgrain.sources.walk import extension, ignored, rules, walk
from lexgrain.streaming.changes import Watcher
from lexgrain.streaming.state import IdleTracker, WatcherState, idle_state


def gram(s):
    return t.trigram(*s.encode())


def test_trigrams():
    assert t.with_offsets(b"") == t.with_offsets(b"ab") == []
    assert t.with_offsets(b"abc") == [(gram("abc"), 0)]
    assert t.with_offsets(b"abcabc") == sorted([(gram("abc"), 0), (gram("abc"), 3), (gram("bca"), 1), (gram("cab"), 2)])
    assert t.with_offsets(b"a\0b") == []
    assert t.with_offsets(b"\xff\xfe\xfd") == [(0xFFFEFD, 0)]
    assert gram("caf") in [g for g, _ in t.with_offsets("café".encode())]
    assert len(t.trigram_set(b"errorerror")) <= 8
    assert t.trigram_set(b"a\0bc") == []


def test_case_groups():
    assert len(t.case_variants(b"abc")) == 8 and len(t.case_variants(b"a1c")) == 4
    assert t.case_groups(b"abcd") == [t.case_variants(b"abc"), t.case_variants(b"bcd")]
    assert t.case_groups(b"ask") == []  # k and s also fold to other code points
    assert t.case_groups("éab".encode()) == []


def test_bloom():
    keys = np.arange(200)
    f = t.bloom(keys)
    assert all(t.bloom_may_contain(f, int(k)) for k in keys)
    assert sum(t.bloom_may_contain(f, k) for k in range(200, 1200)) < 20
    assert t.bloom_may_contain(None, 5) and t.bloom_may_contain(b"short", 5)


@pytest.mark.parametrize(("pattern", "fragments"), [
    ("hello", ["hello"]), ("(foo)bar", ["bar"]), ("(?:foo)bar", ["foobar"]), ("foo|bar", []), ("ab[0-9]cde", ["cde"]), ("(?:abc)+", ["abc"]), ("(?:abc)*def", ["def"]),
    ("x{1}yz", ["xyz"]), ("ab", []), ("éa", ["éa"]), (r"a\.b", ["a.b"]), ("^start$", ["start"]), ("(?i)abc", []),
])
def test_required_literals(pattern, fragments):
    assert dialect.required_literals(dialect.parse(pattern)) == fragments


def test_captures_help_when_not_strict():
    assert dialect.required_literals(dialect.parse("(foo)bar"), into_captures=True) == ["foo", "bar"]


@pytest.mark.parametrize("pattern", ["(", ")", "[a", r"\1", "(?=a)", "(?!a)", "(?<=a)b", "a**b{", "*a", "[z-a]", r"\q", "a{2,1}", "[a--b]", "(?R)", r"\p{", "{"])
def test_invalid_patterns(pattern):
    with pytest.raises(InvalidPattern):
        dialect.to_java(pattern)


def test_translation():
    java = dialect.to_java("foo$")
    assert java.endswith(r"\z") and java.startswith("(?dU)")
    assert r"(?![^\n])" in dialect.to_java("(?m)foo$")
    assert dialect.to_java(r"(?P<year_x>\d+)").endswith(r"((?:\d)+)")
    assert "(?s:.)" in dialect.to_java("a.b", dot_all=True)
    assert "A-Za-z" in dialect.to_java("[[:alpha:]]")


def test_plans():
    assert isinstance(plan("ab"), FullScan) and isinstance(plan("abc"), Literal)
    assert isinstance(plan("ABC", ignore_case=True), CaseInsensitive) and isinstance(plan("ab", ignore_case=True), FullScan)
    assert isinstance(plan("abc[0-9]", regex=True), RegexWithLiterals) and isinstance(plan("[0-9]+", regex=True), FullScan)
    assert isinstance(plan("abc", regex=True, ignore_case=True), FullScan)


def test_options():
    with pytest.raises(InvalidOptions):
        SearchOptions(multiline="line").checked()
    assert expand_types(("cpp", "h", "yaml", "rs")) == ("cpp", "cc", "cxx", "h", "hpp", "yaml", "yml", "rs")


def test_ignore_rules():
    r = rules("*.log\n!keep.log\n/top\nbuild/\na/**/z\n# note\n")
    assert ignored("x/y.log", False, r) and not ignored("x/keep.log", False, r)
    assert ignored("top", False, r) and not ignored("x/top", False, r)
    assert ignored("x/build", True, r) and not ignored("x/build", False, r)
    assert ignored("a/b/c/z", False, r) and ignored("a/z", False, r)
    nested = rules("secret", "sub")
    assert ignored("sub/x/secret", False, nested) and not ignored("secret", False, nested)


@given(st.text("abc/.*", max_size=12), st.text("abc/.", min_size=1, max_size=12))
def test_ignore_rules_never_fail(glob, path):
    ignored(path, False, rules(glob))


def test_walk(tmp_path):
    for name in (".hid/y.rs", "_u.txt", "a.txt", "node_modules/x.js", "img.png", "x.tar.gz", "x.zip", "skip/me.txt", "skip/keep.txt", "b.ig"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    (tmp_path / ".gitignore").write_text("skip/*\n!skip/keep.txt\n")
    (tmp_path / ".lexgrainignore").write_text("*.ig\n")
    got = [f.path for f in walk(str(tmp_path))]
    assert got == [".gitignore", ".hid/y.rs", ".lexgrainignore", "_u.txt", "a.txt", "skip/keep.txt"]
    assert {"x.zip", "x.tar.gz"} <= {f.path for f in walk(str(tmp_path), archives=True)}
    assert extension(".bashrc") == "" and extension("a.tar.gz") == "gz"
    warned = []
    assert list(walk(str(tmp_path / "absent"), lambda p, e: warned.append(p))) == [] and warned


def test_watcher_state(tmp_path):
    s = WatcherState.new(str(tmp_path))
    s.write(str(tmp_path))
    assert WatcherState.read(str(tmp_path)) == s and s.is_live()
    s.pid = 2**22 + 12345
    assert not s.is_live()
    WatcherState.remove(str(tmp_path))
    assert WatcherState.read(str(tmp_path)) is None


def test_idle():
    assert [idle_state(x) for x in (0, 360, 1860)] == ["active", "idle", "dormant"]
    clock = [0.0]
    tracker = IdleTracker(lambda: clock[0])
    clock[0] = 400
    assert tracker.state() == "idle"
    tracker.record_query()
    assert tracker.state() == "active"


def test_watcher(tmp_path):
    w = Watcher(str(tmp_path), poll_s=0.02, silence_ms=100)
    (tmp_path / "test.txt").write_text("x")
    began = time.monotonic()
    assert w.next_batch(2.0) == ["test.txt"] and time.monotonic() - began < 2
    os.remove(tmp_path / "test.txt")
    assert w.next_batch(2.0) == ["test.txt"]
    assert w.next_batch(0.1) == []
    w.stop()
    assert not w.is_running


@given(st.text(max_size=30))
def test_quoted_literals_are_plain(text):
    assert re.sub(r"\\x([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), dialect.literal_to_java(text)) == text


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=9), st.text("abA \0", max_size=40).map(str.encode)), min_size=1, max_size=30), st.integers(1, 60))
def test_runs_of_many_contents(contents, most):
    """Runs are sorted by (trigram, file) over all contents of a piece, and hold what each content holds alone."""
    ids = list(range(len(contents)))[::-1]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 7], pa.int64()), pa.array(contents[i : i + 7], pa.binary())], names=["file_id", "content"]) for i in range(0, len(ids), 7)]
    got = []
    for piece in t.pieces(iter(batches), most):
        sizes = [len(x or b"") for x in piece.column(1).to_pylist()]
        assert sum(sizes) <= most or len(sizes) == 1
        run = list(zip(*(x.tolist() for x in t._counted(piece.column(1), piece.column(0).to_numpy())), strict=True))
        assert run == sorted(run)
        got += run
    want = Counter((g, i) for i, c in zip(ids, contents, strict=True) for g, _ in t.with_offsets(c or b""))
    assert sorted(got) == sorted((*k, n) for k, n in want.items())


def test_one_large_content(monkeypatch):
    monkeypatch.setattr(t, "PIECE", 7)
    data = b"abcab\0cabcabcabx" * 3
    kinds, of, n = t._counted(pa.array([data], pa.binary()), np.array([5]))
    assert dict(zip(kinds.tolist(), n.tolist(), strict=True)) == Counter(g for g, _ in t.with_offsets(data)) and set(of.tolist()) == {5}


def test_hashes_of_trigrams():
    grams = [0, 1, gram("abc"), 0xFFFFFF]
    for seed in (0, 1):
        assert t._xxh64(np.array(grams), seed).tolist() == [xxhash.xxh64_intdigest(g.to_bytes(4, "little"), seed) for g in grams]
