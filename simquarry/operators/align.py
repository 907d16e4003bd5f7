"""Token-to-feature maps, code views and the aligned diff of two functions."""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["collection", "function_id"]
#: Rows unnested from the stored functions are many times what Spark takes them for (their file's
#: size), so joins of whole token, feature or vector tables are told to sort, never to broadcast.
WHOLE = "merge"
DIFF = "pair_id string, row_idx long, tag string, chunk_id long, l_line long, r_line long"
#: Rows of a diff that are held before they are sent.
DIFF_ROWS = 50_000


def token_features(occurrences: DataFrame) -> DataFrame:
    """(token index, feature hashes): the features that point at each token."""
    rows = occurrences.select(*KEY, "hash", F.explode("addr_to_token_idx").alias("idx"))
    return rows.groupBy(*KEY, F.col("idx").cast("long").alias("idx")).agg(F.sort_array(F.collect_list("hash")).alias("hashes"))


def line_identities(tokens: DataFrame, token_hashes: DataFrame) -> DataFrame:
    """Each line from 0 to the function's last with its identity: the sorted distinct features
    on the line, or the stripped text where it has none."""
    rows = tokens.select(*KEY, "line", "idx", "text").join(token_hashes, [*KEY, "idx"], "left")
    lines = rows.groupBy(*KEY, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: t["text"]), "").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("hashes", F.array().cast("array<string>")))))).alias("hashes"))
    span = tokens.groupBy(*KEY).agg(F.max("line").alias("last")).select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("line"))
    out = span.join(lines, [*KEY, "line"], "left")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    featured = F.size(F.coalesce("hashes", F.array().cast("array<string>"))) > 0
    return out.select(*KEY, "line", F.when(featured, F.concat(F.lit("FEATURES:"), F.array_join("hashes", ","))).otherwise(F.concat(F.lit("TEXT:"), plain)).alias("identity"), F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"))


def opcodes(left: list[str], right: list[str]) -> list[tuple]:
    """Aligned rows (tag, chunk, left line, right line), lines from 1, None where a side is
    absent. Lines of equal and replaced chunks pair by position."""
    out = []
    for chunk, (tag, a, b, c, d) in enumerate(difflib.SequenceMatcher(None, left, right).get_opcodes()):
        for k in range(max(b - a, d - c)):
            out.append((tag, chunk, a + k + 1 if a + k < b else None, c + k + 1 if c + k < d else None))
    return out


def _diffs(batches):
    """The diff rows of pairs (pair_id, left, right), whose sides are (line, identity) in order."""
    for batch in batches:
        pairs, sides = batch.column(0), []
        for column in batch.columns[1:]:
            lines = column.flatten().field("identity").to_pylist()
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            sides.append([lines[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        at, rows = [], []

        def out():
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.string(), *[pa.int64()] * 3), strict=True)]
            return pa.RecordBatch.from_arrays([pairs.take(pa.array(at, pa.int64())), *arrays], ["pair_id", "row_idx", "tag", "chunk_id", "l_line", "r_line"])

        for i, (left, right) in enumerate(zip(*sides, strict=True)):
            found = opcodes(left, right)
            at += [i] * len(found)
            rows += [(k, *row) for k, row in enumerate(found)]
            if len(rows) >= DIFF_ROWS:
                yield out()
                at, rows = [], []
        yield out()


def aligned_diff(identities: DataFrame, wanted: DataFrame) -> DataFrame:
    """The diff rows of each wanted (collection1, id1, collection2, id2); a pair's two line lists
    meet in one row. The matcher has no relational form, so this is the one Python step; it
    takes many pairs at a time, since most of them are small."""
    pid = F.concat_ws("|", "id1", "id2").alias("pair_id")
    sides = []
    for k, i in ((0, 1), (1, 2)):
        w = wanted.select(pid, F.col(f"collection{i}").alias("collection"), F.col(f"id{i}").alias("function_id"))
        sides.append(w.join(identities, KEY).select("pair_id", F.lit(k).alias("side"), F.struct("line", "identity").alias("at")))
    own = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("at"))))
    pairs = sides[0].unionByName(sides[1]).groupBy("pair_id").agg(own(0).alias("left"), own(1).alias("right"))
    return pairs.mapInArrow(_diffs, DIFF)


def common_hashes(vec: DataFrame, wanted: DataFrame) -> DataFrame:
    """The features that both functions of each wanted pair have, sorted."""
    v = lambda i: vec.select(F.col("collection").alias(f"collection{i}"), F.col("function_id").alias(f"id{i}"), "hash")
    keys = ["collection1", "id1", "collection2", "id2"]
    both = wanted.select(*keys).join(v(1).hint(WHOLE), ["collection1", "id1"]).join(v(2).hint(WHOLE), ["collection2", "id2", "hash"])
    return both.groupBy(*keys).agg(F.array_sort(F.collect_set("hash")).alias("hashes"))


def token_classes(tokens: DataFrame, token_hashes: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Tokens with diff_class: "match" where a feature is also in `other` (collection,
    function_id, hashes in common), "unique" where some feature isn't, else ""; without `other`,
    "diff-unique" for every token with a feature."""
    rows = tokens.join(token_hashes.hint(WHOLE), [*KEY, "idx"], "left").withColumn("hashes", F.coalesce("hashes", F.array().cast("array<string>")))
    if other is None:
        return rows.withColumn("diff_class", F.when(F.size("hashes") > 0, "diff-unique").otherwise(""))
    rows = rows.join(other.withColumnRenamed("hashes", "common").hint(WHOLE), KEY, "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    match = F.arrays_overlap("hashes", "common")
    return rows.withColumn("diff_class", F.when(match, "match").when(F.size(F.array_except("hashes", "common")) > 0, "unique").otherwise("")).drop("common")


def code_view(tokens: DataFrame, token_hashes: DataFrame, line_to_addr: DataFrame | None = None) -> DataFrame:
    """One row per line of a function, from 1: its tokens in order, each with class and features,
    and the line's first address."""
    rows = token_classes(tokens, token_hashes)
    item = F.struct("idx", "text", "type", "diff_class", "hashes")
    out = rows.groupBy(*KEY, "line").agg(F.array_sort(F.collect_list(item)).alias("tokens"))
    if line_to_addr is not None:
        out = out.join(line_to_addr, [*KEY, "line"], "left")
    return out.withColumn("line_idx", F.col("line") + 1)


def line_addresses(funcs: DataFrame) -> DataFrame:
    rows = funcs.select(*KEY, F.explode("source.line_to_addr").alias("k", "addrs"))
    return rows.select(*KEY, F.col("k").cast("long").alias("line"), F.coalesce(F.try_element_at("addrs", F.lit(1)), F.lit("")).alias("address"))


def feature_view(occurrences: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each feature of a function with the text of its distinct lines, in first-seen order."""
    seen = occurrences.select(*KEY, "hash", "type", "pos", F.posexplode("line_idx").alias("k", "line"))
    seen = seen.groupBy(*KEY, "hash", "type", "line").agg(F.min(F.struct("pos", "k")).alias("at"))
    text = tokens.groupBy(*KEY, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: t["text"]), "").alias("text"))
    rows = seen.join(text, [*KEY, "line"], "left")
    return rows.groupBy(*KEY, "hash", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line", F.coalesce("text", F.lit("")).alias("text")))), lambda r: F.struct(r["line"].alias("line"), r["text"].alias("text"))).alias("lines"))


def line_to_token(tokens: DataFrame) -> DataFrame:
    """The maps that the source document carries, derived from the tokens."""
    return tokens.groupBy(*KEY, "line").agg(F.array_sort(F.collect_list("idx")).alias("token_idx"), F.array_sort(F.collect_set("addr")).alias("addresses"))


def token_index(lines: DataFrame) -> DataFrame:
    """Global token numbers over a function's lines (collection, function_id, line, tokens)."""
    rows = lines.select(*KEY, "line", F.posexplode("tokens").alias("k", "text"))
    w = Window.partitionBy(*KEY).orderBy("line", "k")
    return rows.withColumn("idx", F.row_number().over(w).cast("long") - 1)


#: The colours of features that the other function has, and hasn't.
COMMON, OWN = "#00ff00", "#ff003c"


def token_tips(occurrences: DataFrame, vec: DataFrame, common: DataFrame) -> DataFrame:
    """(function, idx, tips): each token's features as nine values: hash, pcode_op, pcode_op_full,
    type, seq, addr, line_idx, tf ("N/A" where the vector lacks it) and a colour that tells whether
    `common` (function, hashes) has it."""
    rows = occurrences.select(*KEY, "pos", "hash", "pcode_op", "pcode_op_full", "type", "seq", "addr", "line_idx", F.explode("addr_to_token_idx").alias("idx"))
    rows = rows.join(vec.select(*KEY, "hash", "tf").hint(WHOLE), [*KEY, "hash"], "left").join(common.select(*KEY, F.col("hashes").alias("common")).hint(WHOLE), KEY, "left")
    colour = F.when(F.array_contains("common", F.col("hash")), COMMON).otherwise(OWN)
    tip = F.struct("pos", "hash", "pcode_op", "pcode_op_full", "type", "seq", "addr", "line_idx", F.coalesce(F.col("tf").cast("string"), F.lit("N/A")).alias("tf"), colour.alias("colour"))
    return rows.groupBy(*KEY, F.col("idx").cast("long").alias("idx")).agg(F.transform(F.array_sort(F.collect_list(tip)), lambda t: t.dropFields("pos")).alias("tips"))
