"""Many keywords in many texts: one automaton of all keywords passes over each text once."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from math import ceil

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of keywords in one automaton, which takes some 50 times as much memory; larger tables take a pass over the texts for each so many.
SHARD_BYTES = 1 << 20

_automata: OrderedDict[str, ahocorasick.Automaton] = OrderedDict()


def _automaton(name: str, words: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast list, built once in a worker, which keeps the last two."""
    if name not in _automata:
        built = ahocorasick.Automaton()
        for w in words.value:
            built.add_word(w, w)
        built.make_automaton()
        _automata[name] = built
        while len(_automata) > 2:
            _automata.popitem(last=False)
    return _automata[name]


def _held(words: Broadcast, text: Column) -> Column:
    """The distinct words of a broadcast list that are substrings of text, sorted; null for a null text."""
    name = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        machine = _automaton(name, words)
        return texts.map(lambda t: None if t is None else sorted({w for _, w in machine.iter(t)}))

    return found(text)


def keyword_matches(texts: DataFrame, keywords: DataFrame, text: str = "text", word_boundary: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """texts with a column keyword: a row for each distinct keyword (keywords.keyword) that the lower-cased text holds.

    Keywords are plain text, taken as they are: one with capitals is never found. With word_boundary
    an occurrence counts where both its ends are ends of words. The empty keyword is in every text
    (with word_boundary in none without a word); null keywords and null texts match nothing, and
    repeated keywords count once. Any number of keywords: they are dealt to automata of about
    shard_bytes each by hash. Keywords go through the driver one automaton's worth at a time.
    """
    if "keyword" in texts.columns:
        raise ValueError("texts have a column keyword already")
    words = keywords.where("keyword IS NOT NULL").select("keyword").distinct()
    size = words.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    n = max(1, ceil(size / shard_bytes))
    context = texts.sparkSession.sparkContext
    at = F.pmod(F.xxhash64("keyword"), F.lit(n))
    parts = []
    for i in range(n):
        some = [r[0] for r in words.where((F.col("keyword") != "") & (at == i)).collect()]
        if some:
            parts.append(texts.withColumn("keyword", F.explode(_held(context.broadcast(some), F.lower(text)))))
    if not words.where("keyword = ''").isEmpty() or not parts:
        none = F.lit(not words.where("keyword = ''").isEmpty())
        parts.append(texts.where(F.col(text).isNotNull() & none).withColumn("keyword", F.lit("")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if word_boundary:
        literal = F.regexp_replace("keyword", r"([^\p{L}\p{N}_\s])", r"\\$1")
        out = out.where(F.rlike(F.lower(text), F.concat(F.lit(r"\b"), literal, F.lit(r"\b"))))
    return out
