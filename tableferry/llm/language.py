"""Language of texts, and of the spans of mixed texts.

The script of a word narrows the languages it can be in. Each word has a score for each of these
from letter trigrams, and Viterbi with a penalty for each switch labels the sequence of words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.llm.tables import kept, named, steps

# First code points of Unicode blocks, and the script of the letters from there on.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x18B0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"),
    (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "other"), (0xFB50, "Arabic"), (0xFE00, "other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "other"), (0x20000, "Han"), (0x30000, "other"),
)
_FIRST = [first for first, _ in SCRIPT_RANGES]

WORD = re.compile(r"[^\W\d_]+")
#: Cells of one Viterbi table, and words whose scores a task keeps between batches.
CELLS = 1 << 20
WORDS_KEPT = 400_000


def script(letter: str) -> str:
    return SCRIPT_RANGES[bisect_right(_FIRST, ord(letter)) - 1][1]


@dataclass
class Model:
    """Log probabilities of trigrams for each language, and the languages of each script."""

    languages: list[str]
    grams: dict[str, int]
    logs: np.ndarray  # (grams + 1, languages); the last row is for an unknown gram
    scripts: dict[str, list[int]]
    common: int  # the language with most words
    penalty: float
    spread: float
    cache: dict[str, int] = field(default_factory=dict)
    table: list[np.ndarray] = field(default_factory=list)

    def trim(self) -> None:
        if len(self.cache) > WORDS_KEPT:
            self.cache.clear()
        if not self.cache:
            self.table = [np.zeros((2, len(self.languages)), np.float32)]

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of the score table, one for each word; row 0 is a sequence of marks, row 1 a foreign script."""
        cache, new = self.cache, []
        for words in texts:
            for word in words:
                if word not in cache:
                    cache[word] = -1
                    new.append(word)
        if new:
            self._score(new)
        return [np.fromiter((cache[w] for w in words), np.int32, len(words)) for words in texts]

    def _score(self, words: list[str]) -> None:
        rows, first, flat, counts = [], sum(map(len, self.table)), [], []
        unknown, get = len(self.grams), self.grams.get
        able_by_letter: dict[str, list[int] | None] = {}
        for word in words:
            letter = word[0] if word[0].isalpha() else next((c for c in word if c.isalpha()), None)
            if letter is None:
                self.cache[word] = 0
                continue
            if letter not in able_by_letter:
                able_by_letter[letter] = self.scripts.get(script(letter))
            able = able_by_letter[letter]
            if able is None:
                self.cache[word] = 1
                continue
            padded = f"^{word}$"
            found = [get(padded[i : i + 3], unknown) for i in range(len(word))]
            flat += found
            counts.append(len(found))
            rows.append((word, able))
        if not rows:
            return
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        scores = np.add.reduceat(self.logs[np.array(flat)], starts, axis=0)
        scores -= scores.max(axis=1, keepdims=True)
        np.maximum(scores, -self.spread, out=scores)
        for k, (word, able) in enumerate(rows):
            self.cache[word] = first + k
            if len(able) < len(self.languages):
                unable = np.ones(len(self.languages), bool)
                unable[able] = False
                scores[k] -= scores[k, able].max()
                scores[k, unable] = -2 * self.spread
        self.table.append(scores.astype(np.float32))

    def paths(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """The best sequence of languages for each sequence of words."""
        if len(self.table) > 1:
            self.table = [np.concatenate(self.table)]
        order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
        result: list[np.ndarray] = [np.zeros(0, np.int16)] * len(ids)
        block: list[int] = []
        for i in reversed(order):
            if block and len(ids[block[0]]) * (len(block) + 1) > CELLS:
                self._block(block, ids, result)
                block = []
            if len(ids[i]):
                block.append(i)
        if block:
            self._block(block, ids, result)
        return result

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[np.ndarray]]:
        """Language, score and path of words for each text."""
        self.trim()
        langs = self.languages
        words = [WORD.findall(t.lower()) if langs else [] for t in texts]
        ids = self.ids(words)
        paths = self.paths(ids)
        preds, scores = [], []
        for own, rows, path in zip(words, ids, paths):
            weight = np.fromiter(map(len, own), np.int64, len(own)) * (rows > 0)
            if not weight.any():
                preds.append("und"), scores.append(0.0)
                continue
            share = np.bincount(path, weight * (rows > 1), len(langs))
            best = int(share.argmax()) if share.any() else self.common
            preds.append(langs[best])
            scores.append(float(share[best] / weight.sum()))
        return preds, scores, paths

    def _block(self, block: list[int], ids: list[np.ndarray], result: list[np.ndarray]) -> None:
        longest, n = len(ids[block[0]]), len(block)
        words = np.zeros((longest, n), np.int32)
        for k, i in enumerate(block):
            words[: len(ids[i]), k] = ids[i]
        scores, pick = self.table[0], np.arange(n)
        stays = np.zeros((longest, n, len(self.languages)), bool)
        froms = np.zeros((longest, n), np.int16)
        value = scores[words[0]]
        for t in range(1, longest):
            froms[t] = value.argmax(axis=1)
            switch = value[pick, froms[t]][:, None] - self.penalty
            np.greater_equal(value, switch, out=stays[t])
            value = np.maximum(value, switch) + scores[words[t]]
        path = np.zeros((longest, n), np.int16)
        state = value.argmax(axis=1)
        for t in range(longest - 1, 0, -1):
            path[t] = state
            state = np.where(stays[t, pick, state], state, froms[t])
        path[0] = state
        for k, i in enumerate(block):
            result[i] = path[: len(ids[i]), k].copy()


def train(
    docs: DataFrame, learn: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    docs_per_language: int = 1_000, grams_per_language: int = 20_000, penalty: float = 8.0, spread: float = 6.0,
) -> Model:
    """Trigram counts of about `docs_per_language` whole documents of each language.

    A hash of the id picks them. `learn` is a condition on `doc_id`; rows with a null text, language or id
    teach nothing. Of each language the `grams_per_language` most frequent trigrams reach the tasks.
    """
    source = named(docs, doc_id=id_col, text=text_col, lang=lang_col)
    usable = source.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    usable = usable if learn is None else usable.filter(learn)
    # Written first, so the join sees how small it is and the texts stay where they are read.
    sizes = kept(usable.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) * F.col("docs")
    sample = usable.join(sizes, "lang").filter(chance < docs_per_language * (1 << 30))
    words = kept(
        sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
        .filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n")),
        "words",
    )
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    at = F.sequence(F.lit(1), F.length("word"))
    grams = words.select("lang", "n", F.explode(F.transform(at, lambda i: padded.substr(i, F.lit(3)))).alias("gram"))
    grams = kept(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    first = words.groupBy("lang", F.substring("word", 1, 1).alias("letter")).agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in sizes.select("lang").collect())
    number = {lang: k for k, lang in enumerate(languages)}
    index: dict[str, int] = {}
    entries = []
    for lang in languages:
        top = grams.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(grams_per_language)
        entries += [(index.setdefault(r["gram"], len(index)), number[lang], r["n"]) for r in top.collect()]
    counts = np.zeros((len(index) + 1, max(len(languages), 1)))
    for gram, lang, n in entries:
        counts[gram, lang] = n
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))
    by_script: dict[str, np.ndarray] = {}
    total = np.zeros(max(len(languages), 1))
    for r in first.collect():
        if len(r["letter"]) == 1:
            by_script.setdefault(script(r["letter"]), np.zeros(len(languages)))[number[r["lang"]]] += r["n"]
            total[number[r["lang"]]] += r["n"]
    scripts = {}
    for name, n in by_script.items():
        if able := np.flatnonzero(n >= 0.01 * np.maximum(total, 1)).tolist():
            scripts[name] = able
    return Model(languages, index, logs.astype(np.float32), scripts, int(total.argmax()), penalty, spread)


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, text_hash, lang_pred, score, spans) of every row.

    `lang_pred` is the language of most letters, `score` its share of them; letters of a script that no
    learned language uses belong to none. A null text, or one without a letter, is `und` with score 0.
    `spans` are the stretches (start, end, lang) in code points, from first to last word; an empty
    array if not asked for. If nothing was learned, every text is `und`.
    """
    source = named(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sent = source.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([
        *source.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(span)),
    ])
    arrow_span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            preds, scores, paths = sent.value.predict(texts)
            stretches = [_spans(t, p, sent.value.languages) if spans and s != "und" else [] for t, p, s in zip(texts, paths, preds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(stretches, pa.list_(arrow_span))],
                ["doc_id", "text_hash", "lang_pred", "score", "spans"],
            )

    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, min_score: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` in a known language, all columns; a null language is filled in.

    Rejected are texts that are null or have no letter, and those of which less than `min_score` is in one language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, lang_at, columns = docs.columns.index(text_col), docs.columns.index(lang_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, at):
            preds, scores, _ = sent.value.predict([t or "" for t in batch.column(at).to_pylist()])
            stays = [p != "und" and s >= min_score for p, s in zip(preds, scores)]
            own = batch.column(lang_at)
            filled = pa.compute.coalesce(own, pa.array(preds, own.type))
            arrays = [filled if k == lang_at else batch.column(k) for k in range(columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    """Stretches of equal labels; offsets are those of the text as it is, before lower case."""
    at = [m.span() for m in WORD.finditer(text)]
    if len(at) != len(path):  # lower case can split a letter in two
        at = [m.span() for m in WORD.finditer(text.lower())]
    turns = np.flatnonzero(np.diff(path)) + 1
    bounds = [0, *turns.tolist(), len(path)]
    return [{"start": at[a][0], "end": at[b - 1][1], "lang": langs[path[a]]} for a, b in zip(bounds, bounds[1:])]
