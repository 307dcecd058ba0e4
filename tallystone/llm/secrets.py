"""Secret scans with corpus-wide ownership frequency (operator 4).

Candidates are found in every text by three fixed patterns. Each candidate value is hashed, and the
corpus tells in how many repositories and by how many owners a value occurs. Values of many owners
are widely copied examples; values of few owners that look random are live-looking
credentials of their owner. A value looks random by its kind's collision entropy and by not being a
run along the alphabet; the value of an assignment also needs a letter and a digit. Numbers of
characters decide, so every engine agrees.

DataFrame functions only. Positions come from regular expressions alone: the pieces between matches
and the matches alternate, so running sums of their lengths are the matches' bounds. Hashes are
first reduced to distinct (value, owner, repository), with partial aggregation before each shuffle,
so a value that a third of all documents hold is a few rows per task. Verdicts of the most frequent
values, a bounded number, go back to the documents by broadcast, and those of all others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm import common

# The base patterns, and the number of characters a match (assign: its value) needs.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: A match of AKIA[A-Z0-9]+ or [0-9a-f]+ is a whole run, so the least length may stand in the
#: pattern: no shorter run gives a match, and no later start in a short run does.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
#: What the method adds: the value of a candidate with its verdict.
VERDICTS = ("live", "copied")

#: Owners from which a value counts as widely copied.
COPIED_OWNERS = 3
#: A kind's least 2 ** (collision entropy): n characters look random if n * n is at least this many
#: times the sum of the squares of each character's number. 4 is 2 bits, of the 4 that hex can have.
LEAST_SPREAD = (6, 6, 4)
#: At most so many of 5 steps between neighbours may be to the same or the next character.
MOST_STEPS = 4
BLOCK = 128


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def spans(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches: array of (start, kind, end, value), code points.

    Running sums over m matches go in blocks, so that arrays of the result are copied m / BLOCK
    times, not m times.
    """
    every = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), every(0).alias("m"), every(2 if kind == 0 else 0).alias("v"))
    # The piece after the last match has no match beside it.
    each = F.transform(F.filter(parts, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("n"), x["v"].alias("v")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    at = lambda pos, out: F.struct(pos.cast("int").alias("pos"), out.alias("out"))
    one = lambda pos, x: F.struct((pos + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (pos + x["gap"] + x["n"]).alias("end"), x["v"].alias("value"))
    step = lambda acc, x: at(acc["pos"] + x["gap"] + x["n"], F.concat(acc["out"], F.array(one(acc["pos"], x))))

    def summed(each: Column) -> Column:
        block = lambda acc, k: F.aggregate(F.slice(each, k * BLOCK + 1, BLOCK), at(acc["pos"], none), step)
        joined = lambda acc, k: _once(block(acc, k), lambda b: at(b["pos"], F.concat(acc["out"], b["out"])))
        blocks = F.sequence(F.lit(0), F.greatest(((F.size(each) - 1) / BLOCK).cast("int"), F.lit(0)))
        return F.aggregate(blocks, at(F.lit(0), none), joined, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), _once(each, summed)).otherwise(none)


def with_base_spans(df: DataFrame, text_col: str = "text", name: str = "base") -> DataFrame:
    """``df`` with the base spans of the whole text (null: empty), sorted by start, then kind."""
    text = common.text_or_empty(text_col)
    assign = F.filter(spans(text, ASSIGN, 0), lambda s: F.length(s["value"]) >= ASSIGN_LEAST)
    return df.withColumn(name, F.sort_array(F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2))))


def looks_random(value: Column, kind: Column) -> Column:
    """Whether a value of a kind's characters (ASCII) could be drawn at random."""
    n = F.length(value).cast("long")

    def by(chars: Column) -> Column:
        number = lambda c: (n - F.length(F.replace(value, c, F.lit("")))).cast("long")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0).cast("long"), lambda a, c: a + number(c) * number(c))
        codes = F.transform(chars, F.ascii)
        near = F.size(F.filter(F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.size(codes)), lambda a, b: F.abs(a - b) <= 1), lambda x: x))
        spread = F.element_at(F.array(*[F.lit(x) for x in LEAST_SPREAD]), kind + 1)
        mixed = (kind != 0) | (value.rlike("[0-9]") & value.rlike("[A-Za-z]"))
        return (n * n >= spread * squares) & (near * 5 <= (n - 1) * MOST_STEPS) & mixed

    return _once(F.split(value, ""), by)


def candidates(base: Column) -> Column:
    """Distinct values of a document's base spans: (start, end, value_hash, live-looking). The value
    of an assignment ends where its span ends. A value of two kinds is live-looking by either."""
    one = lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), looks_random(s["value"], s["kind"]).alias("random"))
    # Candidates of one place are neighbours after sorting, the live-looking ones last.
    last = lambda all_: F.filter(all_, lambda x, i: (i == F.size(all_) - 1) | F.coalesce((x["start"] != F.get(all_, i + 1)["start"]) | (x["end"] != F.get(all_, i + 1)["end"]), F.lit(True)))
    return _once(F.sort_array(F.transform(base, one)), last)


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """From rows (hash, random, owner, repo): one row per hash with ``owners``, ``repos``, ``copies``
    and ``verdict``: 'copied' from ``copied_owners`` distinct owners, else 'live' if it looks
    random, else null. A null owner or repository is one of its own."""
    pairs = found.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("copies"), F.max("random").alias("random"))
    owners = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("copies").alias("copies"), F.max("random").alias("random"))
    values = owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("copies").alias("copies"), F.max("random").alias("random"))
    return values.withColumn("verdict", F.when(F.col("owners") >= copied_owners, "copied").when(F.col("random"), "live")).drop("random")


def judged(rows: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """From rows (row_id, owner, repo, found: array of candidates): row_id and ``added``, the sorted
    array of (start, verdict number, end, owners, repos, copies) of candidates with a verdict."""
    each = rows.where(F.size("found") > 0).select("row_id", "owner", "repo", F.explode("found").alias("c")).select("row_id", "owner", "repo", "c.*")
    verdicts = common.written(ownership(each.select("hash", "random", "owner", "repo"), copied_owners).where(F.col("verdict").isNotNull()), "verdicts")
    number = F.when(F.col("verdict") == "live", 0).otherwise(1).alias("verdict")
    hot = common.hot_keys(verdicts.select("hash", "copies"), "copies")
    known = common.join_unique(each.select("row_id", "start", "end", "hash"), verdicts, "hash", hot)
    # A group is one document's candidates.
    return known.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", number, "end", "owners", "repos", "copies"))).alias("added"))


def _rendered(spans_col: Column, names: tuple[str, ...]) -> Column:
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(df: DataFrame, owner: Column, repo: Column, id_col: str = "doc_id", text_col: str = "text", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_assign, n_access, n_hex, n_live, n_copied (long),
    ``base`` and ``spans`` (kind:start:end, sorted by start, then kind: assign, access, hex, live,
    copied), max_owners and max_repos (long, of candidates with a verdict; 0 without).

    Null text is empty; rows of the same or no id stay apart; no other column is carried, and the
    id may have any name. Values themselves are never kept, only SHA-256 hashes.
    """
    rows = with_base_spans(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), owner.alias("owner"), repo.alias("repo")), "__text")
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    # One pass over the texts; all that follows is about candidates.
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "__id", "owner", "repo", plain.alias("base"), candidates(F.col("base")).alias("found"))
    rows = common.written(rows, "candidates")
    added = F.coalesce(F.col("added"), F.array().cast("array<struct<start:int,verdict:int,end:int,owners:bigint,repos:bigint,copies:bigint>>"))
    out = rows.select("row_id", "__id", "base").join(judged(rows, copied_owners), "row_id", "left").withColumn("added", added)
    count = lambda of, name, k: F.size(F.filter(of, lambda s: s[name] == k)).cast("long")
    both = F.sort_array(F.concat("base", F.transform("added", lambda s: F.struct(s["start"].alias("start"), (s["verdict"] + len(KINDS)).alias("kind"), s["end"].alias("end")))))
    most = lambda name: F.coalesce(F.array_max(F.transform("added", lambda s: s[name])), F.lit(0)).cast("long").alias(f"max_{name}")
    return out.select(F.col("__id").alias(id_col), *[count("base", "kind", k).alias(f"n_{name}") for k, name in enumerate(KINDS)], *[count("added", "verdict", k).alias(f"n_{name}") for k, name in enumerate(VERDICTS)], _rendered(F.col("base"), KINDS).alias("base"), _rendered(both, KINDS + VERDICTS).alias("spans"), most("owners"), most("repos"))


def redacted(df: DataFrame, owner: Column, repo: Column, text_col: str = "text", mark: str = "[redacted]", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``df`` with live-looking credentials replaced by ``mark``. Rows without any keep their text
    unchanged; widely copied examples and everything else stay. Null texts stay null, repeated rows
    stay rows, and an empty table gives an empty one. The patterns run once: their pass is written.
    Names that begin with ``__`` must not occur."""
    columns = df.columns
    found = with_base_spans(df, text_col, "__base").withColumn("__found", candidates(F.col("__base"))).drop("__base")
    found = common.written(found.withColumns({"__row": F.monotonically_increasing_id(), "__owner": owner, "__repo": repo}), "flagged")
    held = found.where(F.size("__found") > 0)
    live = F.filter("added", lambda s: s["verdict"] == 0)
    added = judged(held.select(F.col("__row").alias("row_id"), F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), F.col("__found").alias("found")), copied_owners).select(F.col("row_id").alias("__row"), live.alias("__live"))
    state = lambda pos, out: F.struct(pos.cast("int").alias("pos"), out.alias("out"))
    text = F.col(text_col)
    cut = lambda a, s: F.when(s["start"] < a["pos"], state(F.greatest(a["pos"], s["end"]), a["out"])).otherwise(state(s["end"], F.concat(a["out"], F.array(F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), F.lit(mark)))))
    clean = F.aggregate("__live", state(F.lit(0), F.array().cast("array<string>")), cut, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["pos"] + 1, F.lit(2**31 - 1))))
    changed = held.join(added, "__row", "left").withColumn(text_col, F.when(F.size("__live") > 0, clean).otherwise(text))
    return found.where(F.size("__found") == 0).select(*columns).unionByName(changed.select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: a document's source is its owner, source and language together its repository."""
    docs = common.documents(spark, sf_dir)
    out = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_copied", "max_owners", "max_repos")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def oracle_sql() -> str:
    """DuckDB SQL for ``query``. Its ``(?i)`` folds beyond ASCII, so the words are spelled out."""
    keys = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
    assign = rf"""({keys})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    found = "\n  UNION ALL ".join(f"SELECT doc_id, source, repo, {kind} AS kind, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d" for kind, p, group in ((0, assign, 2), (1, ACCESS, 0), (2, HEX, 0)))
    names = "['" + "', '".join(KINDS + VERDICTS) + "']"
    joined = f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop), '')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source, concat_ws('/', source, lang) AS repo FROM documents),
k AS ({found}),
s AS (SELECT doc_id, source, repo, kind, p, m, v, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
base AS (
  SELECT doc_id, source, repo, kind, v[i] AS value, start, start + length(m[i]) AS stop
  FROM (SELECT *, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM s)
  WHERE kind <> 0 OR length(v[i]) >= {ASSIGN_LEAST}),
looks AS (
  SELECT *, length(value) * length(value) >= [{", ".join(map(str, LEAST_SPREAD))}][kind + 1] * list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: (length(value) - length(replace(value, c, ''))) * (length(value) - length(replace(value, c, '')))))
         AND 5 * len(list_filter(range(2, length(value) + 1), lambda i: abs(ascii(value[i]) - ascii(value[i - 1])) <= 1)) <= {MOST_STEPS} * (length(value) - 1)
         AND (kind <> 0 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]'))) AS random FROM base),
cand AS (SELECT doc_id, source, repo, stop - length(value) AS start, stop, value, bool_or(random) AS random FROM looks GROUP BY ALL),
own AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT coalesce(source, chr(1)) || chr(2) || coalesce(repo, chr(1))) AS repos, bool_or(random) AS random FROM cand GROUP BY value),
verdicts AS (SELECT value, owners, repos, CASE WHEN owners >= {COPIED_OWNERS} THEN 4 WHEN random THEN 3 END AS kind FROM own),
added AS (SELECT c.doc_id, v.kind, c.start, c.stop, v.owners, v.repos FROM cand c JOIN verdicts v ON c.value = v.value WHERE v.kind IS NOT NULL),
every AS (SELECT doc_id, kind, start, stop, 0 AS owners, 0 AS repos FROM base UNION ALL SELECT * FROM added),
texts AS (SELECT doc_id, {joined} AS spans, coalesce(max(owners), 0) AS max_owners, coalesce(max(repos), 0) AS max_repos FROM every GROUP BY doc_id),
plain AS (SELECT doc_id, {joined} AS base FROM base GROUP BY doc_id),
counts AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS + VERDICTS))} FROM every GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{name}, 0) AS BIGINT) AS n_{name}" for name in KINDS + VERDICTS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       CAST(coalesce(max_owners, 0) AS BIGINT) AS max_owners, CAST(coalesce(max_repos, 0) AS BIGINT) AS max_repos
FROM d LEFT JOIN texts USING (doc_id) LEFT JOIN plain USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
