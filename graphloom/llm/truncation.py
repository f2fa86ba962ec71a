"""Texts that a field limit or a broken transfer cut off.

Intact texts of a bounded sample are cut artificially, at random places and at the limits that
the lengths of each source show. A logistic regression over hashed features of how a text ends
(closing characters, punctuation, brackets, the kind of its last cell, distance to a limit,
whether its last word is a known one) tells the cut from the intact and scores every text.
"""

import json
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import skew
from ..runtime import cut

#: Texts of the training sample at most, and artificial cuts of each.
TRAIN_TEXTS, CUTS_EACH = 20_000, 2
#: Share of cut texts that the training weighs for, penalty on the weights, score of doubtful labels, and iterations of a fit.
PRIOR, REGULARISATION, DOUBTFUL, ROUNDS = 0.2, 1e-4, 0.7, 60
#: Hashed features, and the score from which on a text counts as cut.
BUCKETS, DECISION = 1 << 15, 0.5
#: A limit is a length that this many different texts of a source have, so many times as often as lengths near it.
LIMIT_TEXTS, LIMIT_PEAK, LIMIT_AROUND = 8, 12, 40
#: Texts cut back to a blank or a whole character end so little below a limit.
NEAR_LIMIT = 12
BLOCK = 512
#: Partitions of the training sample, which is bounded: an iteration of a fit is one stage of so many tasks.
FIT_PARTS = 4
SALTS = 32

_MARK = re.compile(r"# (?:(%%)( \[markdown\])?|(In|Out)\[\d*\]:|(stream|error):)$")
_FENCE = re.compile(r"(?m)^```[^`\n]*$")
_TOKEN = re.compile(r"[^\W\d_]+(?:_\w+|\d\w*)*|\d+(?:\.\d+)?|\s+|.", re.S)
_WORD = re.compile(r"[^\W_]\w*")
_LAST_WORD = re.compile(r"\w+$")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_TERMINAL = tuple(".?!。！？…:")
_BRACKETS = {")": "(", "]": "[", "}": "{"}


def shape(line: str, most: int = 24) -> str:
    """``line`` with words as a, A or i, numbers as 9 and blanks as one; its last ``most`` tokens."""
    out = []
    for t in _TOKEN.findall(line[-400:]):
        if t[0].isdigit():
            out.append("9" if "." not in t else f"9.{len(t) - t.index('.') - 1}")
        elif t[0].isalpha():
            out.append("i" if "_" in t or any(c.isdigit() for c in t) else "A" if t[0].isupper() else "a")
        elif t[0].isspace():
            out.append(" ")
        else:
            out.append(t)
    return "".join(out[-most:])


def _balance(line: str) -> str:
    depth, quotes = 0, 0
    for c in line:
        if c in "([{":
            depth += 1
        elif c in _BRACKETS:
            depth -= 1
    for q in "\"'`":
        quotes += line.count(q) % 2
    return f"{max(-2, min(2, depth))},{quotes}"


def _last_cell(text: str) -> tuple[str, list[str], bool]:
    """Kind and lines of the last cell, and whether the frame around it is open."""
    lines = text.split("\n")
    for i in range(len(lines) - 1, -1, -1):
        m = _MARK.match(lines[i])
        if m:
            kind = "prose" if m[2] else "code" if m[1] or m[3] == "In" else "result" if m[3] else m[4]
            body = lines[i + 1 :]
            if kind != "code":
                body = [x[2:] if x.startswith("# ") else x for x in body]
            return "script " + kind, body, False
    fences = list(_FENCE.finditer(text))
    if len(fences) % 2:
        name = (fences[-1][0][3:].split() or [""])[0]
        kind = name if name in ("result", "stream", "error") else "code"
        return "fenced " + kind, text[fences[-1].end() + 1 :].split("\n"), True
    body = text[fences[-1].end() + 1 :] if fences else text
    return ("closed" if fences and not body.strip() else "prose"), body.split("\n"), False


def _length_features(text: str, limits: list[tuple[str, int]]) -> str:
    sizes = {"chars": len(text), "bytes": len(text.encode(errors="surrogatepass"))}
    for unit, limit in limits:
        if sizes[unit] == limit:
            return "limit"
    for unit, limit in limits:
        if 0 < limit - sizes[unit] <= NEAR_LIMIT:
            return "near"
    return "block" if sizes["bytes"] % BLOCK == 0 else "free"


def features(text: str, limits: list[tuple[str, int]]) -> tuple[list[str], str, str]:
    """Features of the end of ``text``, the kind of its last cell, and its last word where it ends in one."""
    length = _length_features(text, limits)
    text = text.replace("\r\n", "\n").lstrip("﻿ \t\n")
    if text.startswith("{") and '"cell' in text:
        try:
            json.loads(text)
            return ["json whole"], "json", ""
        except ValueError:
            return ["json open", f"json {length}"], "json", ""
    kind, body, open_frame = _last_cell(text)
    newline = text.endswith("\n")
    while body and not body[-1].strip():
        body.pop()
    line = body[-1] if body else ""
    before = body[-2] if len(body) > 1 else ""
    stripped = line.strip()
    form = "heading" if stripped.startswith("#") else "item" if stripped[:2] in ("- ", "* ") else "comment" if stripped.startswith(("# ", "-- ")) else "line"
    k = f"{kind} {form if 'prose' in kind or 'code' in kind else ''}"
    last = stripped[-1:] or "none"
    ending = "a" if last.isalpha() else "9" if last.isdigit() else last
    terminal = stripped.rstrip("\"'`*_)»”’").endswith(_TERMINAL)
    tokens = [x for x in _TOKEN.findall(stripped[-300:]) if not x.isspace()]
    ends = [shape(x) for x in tokens[-3:]]
    own, others = shape(line), {shape(x) for x in body[:-1][-60:]}
    out = [
        f"open {open_frame}", f"{k}|{length}", f"{k}|nl {newline}", f"{length}|nl {newline}|{terminal}", f"{k}|end {ending}|nl {newline}",
        f"{k}|last {'|'.join(ends)}", f"{k}|last {'|'.join(ends[-2:])}", f"{k}|words {' '.join(tokens[-1:])}", f"{k}|words {' '.join(tokens[-2:])}",
        f"{k}|full {own}", f"{k}|balance {_balance(line)}", f"{k}|terminal {terminal}", f"{k}|known {own in others}|{ending}",
        f"{k}|start {' '.join(tokens[:2])}|terminal {terminal}", f"{k}|empty {not stripped}",
        f"words {' '.join(tokens[-1:])}|nl {newline}", f"words {' '.join(tokens[-2:])}|nl {newline}", f"words {' '.join(tokens[-3:])}", f"full {own}|nl {newline}",
    ]
    if before:
        other = before.strip()
        out.append(f"{k}|echo {bool(stripped) and other.startswith((stripped + ' =', stripped + ' <-'))}")
        out.append(f"{k}|like {shape(before) == own}|{len(before.rstrip()) - len(line.rstrip()) if 'result' in kind and abs(len(before) - len(line)) < 2 else 'x'}")
        out.append(f"{k}|end before {other.rstrip(chr(34) + chr(39) + '`*_)').endswith(_TERMINAL)}|{terminal}")
        if "result" in kind:
            out.append(f"{k}|width {(len(before.rstrip()) > len(line.rstrip())) - (len(before.rstrip()) < len(line.rstrip()))}|{len(before.split()) - len(line.split())}")
    if tokens and (m := _BASE64.search(stripped[-300:])):
        whole = stripped[stripped.rfind(" ") + 1 :]
        data = re.search(r"[A-Za-z0-9+/]*(=*)\W*$", whole[-100:])
        out.append(f"image|{data[1]}|{len(whole.rstrip('=)\"')) % 4 if m else ''}|{ending if not ending.isalnum() else 'a'}|nl {newline}")
        out.append(f"image|{k}|{ending if not ending.isalnum() else 'a'}")
    word = _LAST_WORD.search(stripped)
    if not word:
        return out, k, ""
    w = word[0]
    if not newline:
        seen = Counter(_WORD.findall(text))
        seen[w] -= 1  # the end of the text
        itself = seen[w] > 0
        part = not itself and any(x.startswith(w) and len(x) > len(w) for x in seen)
        out += [f"{k}|single {len(tokens) == 1}|{itself}|{part}", f"{k}|here {itself}|{part}", f"here {itself}|{part}|{terminal}"]
    return out, k, w if not newline else ""


def field_limits(lengths: DataFrame) -> dict[str, list[tuple[str, int]]]:
    """Limits of each source: lengths in characters or bytes that stand out of those around them.

    ``lengths`` has ``source, chars, bytes`` of every different text; sources and limits are few.
    """
    one = lengths.select("source", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "size"))
    counts = one.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    peaks = counts.where(F.col("n") >= LIMIT_TEXTS)
    spread = F.sequence(F.col("size") - LIMIT_AROUND, F.col("size") + LIMIT_AROUND)
    around = peaks.select("source", "unit", F.col("size").alias("limit"), F.col("n").alias("peak"), F.explode(spread).alias("size"))
    around = around.where("size <> limit").join(counts, ["source", "unit", "size"], "left").groupBy("source", "unit", "limit", "peak")
    found = around.agg(F.sum(F.coalesce("n", F.lit(0))).alias("near")).where(F.col("peak") >= LIMIT_PEAK * F.greatest(F.lit(0.25), F.col("near") / (2 * LIMIT_AROUND)))
    limits: dict[str, list[tuple[str, int]]] = {}
    for r in found.collect():
        limits.setdefault(r["source"], []).append((r["unit"], r["limit"]))
    return limits


def cut_artificially(text: str, rng: random.Random, limits: list[tuple[str, int]]) -> str:
    """``text`` cut at a random place, a block's end or one of ``limits``, now and then back to a blank."""
    size = len(text)
    at = rng.randrange(min(40, size - 1), size - 1) if size > 42 else max(1, size // 2)
    way = rng.random()
    fitting = [x for x in limits if x[1] < size]
    if way < 0.25 and fitting:
        unit, limit = rng.choice(fitting)
        short = text[:limit] if unit == "chars" else text.encode(errors="surrogatepass")[:limit].decode(errors="ignore")
    elif way < 0.45 and size > BLOCK:
        data = text.encode(errors="surrogatepass")
        short = data[: BLOCK * rng.randint(1, max(1, (len(data) - 1) // BLOCK))].decode(errors="ignore")
    else:
        short = text[:at]
    if rng.random() < 0.2 and (blank := short.rstrip().rfind(" ")) > len(short) - NEAR_LIMIT and blank > 0:
        short = short[:blank]
    return short


#: Rows of the one pass over the texts: a description of a text, an example for the fit, the count of a word.
TEXT, EXAMPLE, COUNT = 0, 1, 2


def _hash(word: str) -> int:
    """64 bits, so that a long word costs no more than a short one."""
    return xxhash.xxh64_intdigest(word.encode(errors="surrogatepass")) - (1 << 63)


def _described(found: tuple[list[str], str, str]) -> tuple[np.ndarray, int | None, int | None]:
    """Hashed features and, where the text ends in a word, hashes of the cell's kind and of the word."""
    f, kind, word = found
    short = lambda x: xxhash.xxh32_intdigest(x.encode(errors="surrogatepass")) - (1 << 31)
    return np.array([short(x) for x in f], dtype=np.int32), short(kind) if word else None, _hash(word) if word else None


def _examples(text: str, own: list[tuple[str, int]], everywhere: list[tuple[str, int]]) -> Iterator[tuple]:
    """``(label, half, features, kind, word)`` of a text taken as intact and of artificial cuts of it."""
    found = features(text, own)
    if "json open" in found[0] or _length_features(text, own) in ("limit", "near"):
        return  # hardly intact
    rng = random.Random(f"{len(text)} {text[:200]}")
    half = rng.randrange(2)
    yield 0.0, half, *_described(found)
    for _ in range(CUTS_EACH if len(text) > 60 else 0):
        yield 1.0, half, *_described(features(cut_artificially(text, rng, own or everywhere), own or everywhere))


def _read(texts: DataFrame) -> DataFrame:
    """All that the texts are read for, in one pass: descriptions, examples, and words with partial counts.

    Another pass before it, inside the JVM, finds the limits. A word is counted where it isn't the
    last of its text.
    """
    kind = texts.schema["k"].dataType.simpleString()
    sizes = cut(texts.select(F.col("s").alias("source"), F.length("t").alias("chars"), F.octet_length("t").alias("bytes"), F.xxhash64("t").alias("h")))
    limits = field_limits(sizes.distinct())
    everywhere = sorted({x for each in limits.values() for x in each})
    share = int(min(1.0, TRAIN_TEXTS / max(1, sizes.count())) * 1_000_000)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, words = [], Counter()
            for k, t, s, chosen in zip(batch["k"], batch["t"], batch["s"], batch["chosen"]):
                words.update(_WORD.findall(t)[:-1])
                own = limits.get(s, [])
                rows.append((TEXT, k, s, None, None, *_described(features(t, own)), None))
                if chosen:
                    rows += [(EXAMPLE, None, None, *x, None) for x in _examples(t, own, everywhere)]
            yield pd.DataFrame(rows, columns=names).astype(types)
            if words:
                counts = pd.DataFrame({"what": COUNT, "word": [_hash(w) for w in words], "n": list(words.values())})
                yield counts.assign(**dict.fromkeys(set(names) - set(counts)))[names].astype(types)

    names = ["what", "k", "s", "label", "half", "f", "kind", "word", "n"]
    types = {"half": "Int32", "kind": "Int32", "word": "Int64", "n": "Int64"}
    chosen = F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share
    schema = f"what int, k {kind}, s string, label double, half int, f array<int>, kind int, word long, n long"
    return cut(texts.withColumn("chosen", chosen).mapInPandas(read, schema))


def _told(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Features of whether the last word is known elsewhere; rows that end in none keep theirs and join nothing."""
    n = F.coalesce("n", F.lit(0))
    level = F.when(n == 0, 0).when(n < 3, 1).when(n < 10, 3).when(n < 100, 10).otherwise(100)
    ending = rows.where("word is not null")
    hot = skew.hot_keys(ending, "word")
    known = skew.replicate(words, "word", hot, SALTS)
    met = ending.withColumn("salt", skew.salt("word", F.monotonically_increasing_id(), hot, SALTS)).join(known, ["word", "salt"], "left")
    met = met.withColumn("f", F.concat("f", F.array(F.hash(level), F.hash("kind", level))))
    return rows.where("word is null").drop("word", "kind").unionByName(met.drop("word", "kind", "salt", "n"))


def _prepared(df: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Texts as ``k, s, f`` and examples as ``label, half, f``."""
    named = [(c, F.col(f"`{n}`").alias(c)) for c, n in (("k", key), ("t", text), ("s", source))]
    texts = df.select(*(c for _, c in named)).where(F.col("t").rlike(r"\S")).withColumn("s", F.coalesce("s", F.lit("")))
    rows = _read(texts)
    described, examples = rows.where(F.col("what") == TEXT), rows.where(F.col("what") == EXAMPLE)
    # Of all words, only those that a text ends in are asked for.
    asked = rows.where(F.col("what") != COUNT).select("word").where("word is not null").distinct()
    words = rows.where(F.col("what") == COUNT).select("word", "n").join(asked, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(words)
    sample = cut(_told(examples.select("label", "half", "f", "kind", "word"), words).repartition(FIT_PARTS, F.xxhash64("f"), "label"))
    return _told(described.select("k", "s", "f", "kind", "word"), words), sample


def _hashed(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="f", outputCol="x", numFeatures=BUCKETS, binary=True).transform(rows)


def _cut_probability() -> Column:
    return vector_to_array("probability")[1]


class _Fit:
    """Logistic regressions over a sample with rows of both kinds."""

    def __init__(self, sample: DataFrame, found: dict[float, int]) -> None:
        self.rows, self.found = _hashed(sample), found
        self.regression = LogisticRegression(featuresCol="x", weightCol="weight", regParam=REGULARISATION, maxIter=ROUNDS, standardization=False)

    def weighed(self, rows: DataFrame, prior: float) -> DataFrame:
        weight = F.when(F.col("label") == 1, prior / self.found[1.0]).otherwise((1 - prior) / self.found[0.0])
        return rows.withColumn("weight", weight * sum(self.found.values()))

    def clean(self) -> DataFrame:
        """Without intact rows that look cut. Some texts that are taken as intact are cut: each half is judged by a model of the other."""
        rows, out = self.weighed(self.rows, 0.5), []
        for half, model in enumerate(self.of_other_half(rows, self.regression.fit)):
            judged = model.transform(rows.where(F.col("half") == half))
            out.append(judged.where((F.col("label") == 1) | (_cut_probability() < DOUBTFUL)).select("label", "half", "x"))
        return cut(out[0].unionByName(out[1]))

    def of_other_half(self, rows: DataFrame, fit: Callable) -> list:
        """The models that judge halves 0 and 1. Iterations are short jobs, so both fits run at once."""
        with ThreadPoolExecutor(2) as pool:
            return list(pool.map(lambda half: fit(rows.where(F.col("half") != half)), (0, 1)))

    def model(self, rows: DataFrame):
        return self.regression.fit(self.weighed(rows, PRIOR))


def _fit(sample: DataFrame) -> _Fit | None:
    found = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    return _Fit(sample, found) if len(found) == 2 else None


def score(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(key, source, score)`` of every text that is neither NULL nor blank; a high score means cut.

    The classifier is fitted on up to ``TRAIN_TEXTS`` texts; limits, word counts and scores come
    from all of them. Every row is scored by itself, repeated ones included. An empty input gives
    an empty result. Without training rows of both kinds nothing can be fitted and every
    score is 0.
    """
    described, sample = _prepared(df, key, text, source)
    fit = _fit(sample)
    if fit is None:
        return described.select(F.col("k").alias(key), F.col("s").alias(source), F.lit(0.0).alias("score"))
    scored = fit.model(fit.clean()).transform(_hashed(described))
    return scored.select(F.col("k").alias(key), F.col("s").alias(source), _cut_probability().alias("score"))


def held_out_accuracy(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(label, n, n_called_cut)`` of the sample: each half's texts and artificial cuts, judged by a model of the other half.

    Label 0 has texts taken as intact, among them those that are cut in truth.
    """
    fit = _fit(_prepared(df, key, text, source)[1])
    if fit is None:
        return df.sparkSession.createDataFrame([], "label double, n long, n_called_cut long")
    rows, parts = fit.clean(), []
    for half, model in enumerate(fit.of_other_half(rows, fit.model)):
        parts.append(model.transform(fit.rows.where(F.col("half") == half)).select("label", _cut_probability().alias("p")))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") >= DECISION).alias("n_called_cut"))
