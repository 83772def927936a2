"""Chunks of long texts: cut at sentence ends under a word budget, with overlap, every chunk with its place in the text.

A text is split into sentences, and those over the budget into runs of words; an aggregate over these parts decides where
chunks begin, and the text of a chunk is put together from its parts. All of it are SQL functions on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r" \t\n\r"
# A sentence ends behind . ! ? and white space, or behind a line end; the white space that follows belongs to it.
SENTENCE_END = rf"([.!?][{SPACE}]+|\n[{SPACE}]*)"
CUT = "\x1f\x1ecut\x1e\x1f"


def _words(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+"))


def sentences(text: Column) -> Column:
    """The sentences of a text; together they are the text. A text that holds the mark of a cut itself is one sentence."""
    parts = F.filter(F.split(F.regexp_replace(text, SENTENCE_END, f"$1{CUT}"), CUT), lambda s: s != "")
    return F.when(text.contains(CUT), F.array(text)).otherwise(parts)


def parts(text: Column, most: int) -> Column:
    """(text, words, chars) of the sentences, those of more than ``most`` words in runs of that many words."""
    run = rf"[{SPACE}]*(?:[^{SPACE}]+[{SPACE}]*+){{1,{most}}}+"
    cut = lambda s: F.when(_words(s) <= most, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(f"({run})")))
    fine = F.flatten(F.transform(sentences(text), cut))
    return F.transform(fine, lambda s: F.struct(s.alias("text"), _words(s).cast("int").alias("words"), F.length(s).cast("int").alias("chars")))


def chunk_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 200, overlap: int = 20) -> DataFrame:
    """(key, chunk, chunks, start, stop, repeated, words, text): every text in chunks of at most ``budget`` words.

    A chunk takes as many whole sentences as fit beside ``overlap`` words; before them it repeats the last sentences of the
    chunk before, as far as they hold ``overlap`` words at most and lie in that chunk's own part. ``start`` and ``stop`` are
    offsets in characters, ``repeated`` says how many characters the chunk before has as well: without them, the chunks of
    a text put together are the text. A sentence with more words is cut within; a single word never is. A null, empty or
    blank text has no chunks; repeated rows are chunked each. The work on a text is in proportion to its length, but for
    the list of its chunks.
    """
    if not 0 <= overlap < budget:
        raise ValueError("overlap must be at least 0 and less than the budget")
    own = budget - overlap
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where(F.col("_text").rlike(f"[^{SPACE}]"))
    rows = rows.select("_key", parts(F.col("_text"), own).alias("parts"))
    begin = """aggregate(parts, named_struct('cuts', array(named_struct('first', 0, 'at', 0)), 'n', 0, 'words', 0, 'chars', 0),
      (s, p) -> named_struct(
        'cuts', if(s.words > 0 and p.words > 0 and s.words + p.words > {own}, concat(s.cuts, array(named_struct('first', s.n, 'at', s.chars))), s.cuts),
        'n', s.n + 1, 'words', if(s.words > 0 and p.words > 0 and s.words + p.words > {own}, p.words, s.words + p.words), 'chars', s.chars + p.chars),
      s -> s.cuts)"""
    rows = rows.withColumn("cuts", F.expr(begin.format(own=own)))
    # Each chunk's own parts, and those of the chunk before from the last one backwards.
    mine = """transform(cuts, (c, k) -> named_struct('chunk', k, 'at', c.at,
      'own', slice(parts, c.first + 1, if(k + 1 < size(cuts), cuts[k + 1].first, size(parts)) - c.first),
      'back', if(k = 0, slice(parts, 1, 0), reverse(slice(parts, cuts[k - 1].first + 1, c.first - cuts[k - 1].first)))))"""
    one = rows.select("_key", F.size("cuts").alias("chunks"), F.inline(F.expr(mine)))
    taken = F.expr(f"""aggregate(back, named_struct('n', 0, 'words', 0, 'chars', 0, 'open', true),
      (s, p) -> if(s.open and s.words + p.words <= {overlap}, named_struct('n', s.n + 1, 'words', s.words + p.words, 'chars', s.chars + p.chars, 'open', true),
                   named_struct('n', s.n, 'words', s.words, 'chars', s.chars, 'open', false)))""")
    shown = one.withColumn("t", taken).withColumn("all", F.expr("concat(reverse(slice(back, 1, t.n)), own)"))
    total = lambda c: F.aggregate(F.col("own"), F.lit(0), lambda s, p: s + p[c])
    return shown.select(
        F.col("_key").alias(key), "chunk", "chunks", (F.col("at") - F.col("t.chars")).alias("start"), (F.col("at") + total("chars")).alias("stop"),
        F.col("t.chars").alias("repeated"), (total("words") + F.col("t.words")).alias("words"),
        F.array_join(F.transform("all", lambda p: p["text"]), "").alias("text"))
