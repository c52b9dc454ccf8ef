"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Training counts byte n-grams (1 to 4 bytes of lower-cased words with a mark at either
end, hashed to a table) and scripts by language, over a sample of labelled rows: about
PER_LANGUAGE rows a language, drawn by a hash of identifier and text, whole texts of any
length; a task counts a language and sends its table.  Everything else covers whole texts
of all rows.

Words are runs of other than white space, and single characters of scripts that are written
without spaces.  A word's score in a language is the sum of its n-grams' log probabilities,
against the mean language; languages that don't write the word's script (that of its first
letter) are excluded.  A path through the words pays SWITCH for each change of language; the
best path's runs are the spans.  The language with most letters wins; its share of all
letters is the score.

Results for odd input: null, empty and letterless texts give `und`, score 0; a word in
a script that no language writes counts for none, so a text of such words gets the first
language with score 0; ties go to the first language by code point; repeated rows are judged
alike; an empty table gives an empty result; where no row is labelled all are `und`; extra
columns are ignored in training, and `predict` replaces columns of the names that it adds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, trim
from .packed import pack, unpack
from .packing import slices

#: Expected rows of the training sample for each language.
PER_LANGUAGE = 800
#: Buckets of the n-gram table, cost of a change of language, score of an excluded language, part of its letters in a script that makes a language its writer.
BUCKETS, SWITCH, EXCLUDED, WRITES = 1 << 17, 12.0, -40.0, 0.02
UND = "und"
#: First code point of runs of Unicode blocks, and the script from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "None"), (0x2C00, "Other"), (0x2E00, "None"), (0x2E80, "Han"), (0x3000, "None"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xE000, "None"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"), (0xFE00, "None"), (0xFE70, "Arabic"), (0xFF00, "None"), (0xFF21, "Latin"), (0xFF5B, "None"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "None"),
    (0x10000, "Other"), (0x1F000, "None"), (0x20000, "Han"), (0x30000, "Other"),
)
#: Characters that stand for a word of their own.
UNSPACED = r"([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}])"
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({b for _, b in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(b) for _, b in SCRIPTS])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased words, each word's place among them, and each text's first word (one more at the end)."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    unspaced = pc.match_substring_regex(low, UNSPACED)
    if pc.any(unspaced).as_py():
        low = pc.if_else(unspaced, pc.replace_substring_regex(low, UNSPACED, r" \1 "), low)
    parts = pc.utf8_split_whitespace(low)
    first = parts.offsets.to_numpy().astype(np.int64)
    words = parts.flatten().dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), first - first[0]


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets, the word of each, letters of each word, script of each word."""
    n = len(words)
    marked = pc.binary_join_element_wise("^", words, "$", "")
    offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + n + 1].astype(np.int64)
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out, of, code, same = [], [], np.zeros(len(data), np.uint64), np.ones(len(data), bool)
    wide = data.astype(np.uint64)
    for k in range(4):
        if k:
            same = np.zeros(len(data), bool)
            same[: len(data) - k] = owner[k:] == owner[: len(data) - k]
        nxt = np.zeros(len(data), np.uint64)
        nxt[: len(data) - k] = wide[k:]
        code = code * np.uint64(257) + nxt + np.uint64(1)
        h = (code + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 17)
        out.append(h[same].astype(np.int64))
        of.append(owner[same])
    # code points of letters: lead bytes of UTF-8
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = [wide[np.minimum(at + i, max(len(data) - 1, 0))] & np.uint64(0x3F) for i in range(1, 4)]
    x = wide[at]
    cp = np.where(x < 0x80, x, np.where(x < 0xE0, (x & np.uint64(31)) << np.uint64(6) | b[0], np.where(x < 0xF0, (x & np.uint64(15)) << np.uint64(12) | b[0] << np.uint64(6) | b[1], (x & np.uint64(7)) << np.uint64(18) | b[0] << np.uint64(12) | b[1] << np.uint64(6) | b[2])))
    kinds = _SCRIPT[np.searchsorted(_FIRST, cp.astype(np.int64), "right") - 1]
    letter = ((x >= 0xC3) & (kinds != _NAMES.index("None")) & (cp != 0xD7) & (cp != 0xF7)) | ((x >= 97) & (x <= 122))
    who, kinds = owner[at][letter], kinds[letter]
    letters = np.bincount(who, minlength=n)
    script = np.full(n, -1)
    script[who[::-1]] = kinds[::-1]  # that of the first letter
    return np.concatenate(out), np.concatenate(of), letters, script


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: log probability less the mean over languages
    writes: np.ndarray  # scripts x languages

    def score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words x languages scores, letters of each word, and those of its letters that some language writes."""
        h, of, letters, script = grams(words)
        out = np.empty((len(words), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(of, self.table[h, k], len(words))
        out[letters == 0] = 0
        known = (script >= 0) & self.writes[script].any(1)
        out[known] += np.where(self.writes[script[known]], 0, EXCLUDED).astype(np.float32)
        out[(script >= 0) & ~known] = 0
        return out, letters, np.where(known, letters, 0)


class Remembered:
    """A model's scores of the distinct words that a task has met; words of `most` bytes in all are kept, each counted with 100 more."""

    def __init__(self, model: Model, most: int = 32 << 20):
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.bytes = 0
        self.held = [np.zeros((1 << 14, len(self.model.languages)), np.float32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)]

    def score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.bytes > self.most:
            self.forget()
        at, n = self.at, len(self.at)
        texts = words.to_pylist()
        new = [w for w in texts if w not in at]
        if new:
            self.bytes += sum(map(len, new)) + 100 * len(new)
            while n + len(new) > len(self.held[1]):
                self.held = [np.concatenate([x, np.zeros_like(x)]) for x in self.held]
            for a in range(0, len(new), SCORED):
                b = min(a + SCORED, len(new))
                for x, y in zip(self.held, self.model.score(pa.array(new[a:b], pa.string())), strict=True):
                    x[n + a : n + b] = y
            at.update(zip(new, range(n, n + len(new)), strict=True))
        slots = np.fromiter((at[w] for w in texts), np.int64, len(texts))
        return tuple(x[slots] for x in self.held)


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket, and letters by script, of texts."""
    words, which, _ = words_of(texts)
    h, of, letters, script = grams(words)
    times = np.bincount(which, minlength=len(words))
    return np.bincount(h, times[of], BUCKETS), np.bincount(script + 1, times * letters, len(_NAMES) + 1)[1:]


def modelled(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model of each language's counts."""
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    times, wrote = (np.stack([counts[k][i] for k in languages], 1) for i in (0, 1))
    p = np.log((times + 0.5) / (times.sum(0) + 0.5 * BUCKETS))
    table = np.where(times.sum(1)[:, None] > 0, p - p.mean(1, keepdims=True), 0).astype(np.float32)
    return Model(languages, table, wrote > WRITES * wrote.sum(0))


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows."""
    return modelled({k: counted(pa.array([t for x, t in rows if x == k], pa.string())) for k in {r[0] for r in rows}})


def viterbi(scores: np.ndarray, which: np.ndarray, first: np.ndarray, cost: float = SWITCH) -> np.ndarray:
    """The language of each word on its text's best path; all texts advance together, longest first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    starts, longest = first[:-1][order], int(n.max(initial=0))
    active = np.searchsorted(-n[order], -np.arange(longest), "left")  # texts with more than t words
    back, label = np.zeros((len(which), scores.shape[1]), np.int8 if scores.shape[1] < 128 else np.int32), np.zeros(len(which), np.int64)
    if not len(which):
        return label
    own = np.arange(scores.shape[1])
    v, state = np.zeros((len(n), scores.shape[1]), np.float32), np.zeros(len(n), np.int64)
    for t in range(longest):
        a = active[t]
        at, x = starts[:a] + t, v[:a]
        best = x.argmax(1)
        least = x[np.arange(a), best] - np.float32(cost)
        stay = x >= least[:, None]
        back[at] = np.where(stay, own, best[:, None])
        v[:a] = np.where(stay, x, least[:, None]) + scores[which[at]]
    state = v.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        label[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return label


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of a bounded sample of labelled(doc_id, text, lang); a count and a table of BUCKETS counts a language reach the driver."""
    rows = labelled.where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return modelled({})
    cut = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])[F.col("lang")]
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < cut

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        sent = lambda: pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pack({"n": sums[0], "wrote": sums[1]})], pa.binary())], names=["lang", "blob"])
        for batch in batches:
            for part in slices(batch, AT_ONCE):
                for lang in dict.fromkeys(part.column(0).to_pylist()):  # sorted
                    if lang != at:
                        if sums is not None:
                            yield sent()
                        at, sums = lang, (np.zeros(BUCKETS), np.zeros(len(_NAMES)))
                    more = counted(part.column(1).filter(pc.equal(part.column(0), lang)))
                    sums = (sums[0] + more[0], sums[1] + more[1])
        if sums is not None:
            yield sent()

    sample = rows.where(drawn).select("lang", "text").repartition(len(counts), "lang").sortWithinPartitions("lang")
    return modelled({r["lang"]: ((x := unpack(r["blob"]))["n"], x["wrote"]) for r in sample.mapInArrow(lean(work), "lang string, blob binary").collect()})


#: Bytes of text that are labelled at once, and new words that are scored at once.
AT_ONCE, SCORED = 4_000_000, 1 << 14


def judged(docs: DataFrame, model: Model, spans: bool = False) -> Column:
    """A struct lang, score (and spans) of docs' text; only the text goes through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x languages
    kind = "struct<lang: string, score: double" + (", spans: array<struct<first_word: int, words: int, lang: string>>>" if spans else ">")

    @F.arrow_udf(kind)
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Remembered(shared.value)
        for texts in batches:
            parts = [label(m, part.column(1), spans) for part in slices(pa.RecordBatch.from_arrays([texts, texts], names=["i", "text"]), AT_ONCE)]
            whole = [pa.concat_arrays([p[i] for p in parts]) for i in range(2 + spans)] if parts else label(m, texts, spans)
            yield pa.StructArray.from_arrays(whole, names=["lang", "score", "spans"][: 2 + spans])

        m.forget()
        trim()

    return work(F.col("text"))


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs with lang_pred, score, and with spans lang_spans, an array of (first_word, words, lang) structs.

    Where a text starts or ends with white space, an empty word stands there."""
    at = f"judged {uuid.uuid4().hex}"
    new = {"lang_pred": "lang", "score": "score"} | ({"lang_spans": "spans"} if spans else {})
    out = docs.withColumn(at, judged(docs, model, spans))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[F.col(f"`{at}`.{x}").alias(c) for c, x in new.items()])


def label(m: Remembered, texts: pa.Array, spans: bool) -> list[pa.Array]:
    words, which, first = words_of(texts)
    count, k = len(first) - 1, len(m.model.languages)
    if not k:
        return [pa.array([UND] * count, pa.string()), pa.array([0.0] * count, pa.float64()), *([pa.array([[]] * count, SPANS)] if spans else [])]
    scores, letters, known = m.score(words)
    lab = viterbi(scores, which, first)
    owner = np.repeat(np.arange(count), np.diff(first))
    sums = np.bincount(owner * k + lab, known[which], count * k).reshape(count, k)
    best, total = sums.argmax(1), np.bincount(owner, letters[which], count)
    has = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    score = np.where(has & (total > 0), sums.max(1) / np.maximum(total, 1), 0.0)
    names = np.array([*m.model.languages, UND], object)
    out = [pa.array(names[np.where(has, best, k)], pa.string()), pa.array(score)]
    if spans:
        new = np.ones(len(lab), bool)
        new[1:] = (lab[1:] != lab[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        long = np.diff(np.append(at, len(lab)))
        structs = pa.StructArray.from_arrays([pa.array((at - first[owner[at]]).astype(np.int32)), pa.array(long.astype(np.int32)), pa.array(names[lab[at]], pa.string())], names=["first_word", "words", "lang"])
        out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), structs))
    return out


SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))


def held_out() -> Column:
    """True for the third of the rows that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


#: A document whose main language has less of its letters than this is turned away, as is one without any.
LEAST_SHARE = 0.25


def accepted(docs: DataFrame) -> DataFrame:
    """docs whose language is clear, by a model of their own labelled rows; all columns stay. Where no row is labelled all pass."""
    model = train(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs
    at = f"judged {uuid.uuid4().hex}"
    found = docs.withColumn(at, judged(docs, model))
    return found.where((F.col(f"`{at}`.lang") != UND) & (F.col(f"`{at}`.score") >= LEAST_SHARE)).select(*[F.col(f"`{c}`") for c in docs.columns])
