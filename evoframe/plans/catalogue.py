"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoframe.functions import metrics, sequences
from evoframe.functions.hashing import first_by_hash
from evoframe.operators import activities, budget, clean, colony, evolution, flight, matrix, models, nearest, objectives, pairs, pareto, search, selection, swarm

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, name: str | None = None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if oracle:
            ORACLES[key] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# Pairs ------------------------------------------------------------------------------

_SEED = 7


def _pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


def _held(column: str, seed: int) -> str:
    return f"""SELECT {column} AS v FROM (SELECT {column}, row_number() OVER (ORDER BY md5('{seed}|' || {column}), {column}) AS nth,
      count(*) OVER () AS total FROM (SELECT DISTINCT {column} FROM lineitem)) WHERE nth <= greatest(1, round_even(0.2 * total, 0))"""


def _split_query(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _pair_table(spark, sf_dir)
        rows = rows.distinct() if mode == "random" else rows  # a random split needs rows that can be told apart
        split = pairs.cold_split(rows, "l_suppkey", "l_partkey", 0.2, mode, _SEED, tuple(rows.columns))
        return split.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "split")

    return run


_SIDES = {"drug": (f"l_suppkey IN ({_held('l_suppkey', _SEED)})",), "target": (f"l_partkey IN ({_held('l_partkey', _SEED)})",)}
_SIDES["both"] = (*_SIDES["drug"], f"l_partkey IN ({_held('l_partkey', _SEED + 1)})")
for _mode, _tests in _SIDES.items():
    query(f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN {" AND ".join(_tests)} THEN 'test'
      WHEN {" OR ".join(_tests)} THEN 'dropped' ELSE 'train' END AS split FROM lineitem""", f"cold_split_{_mode}")(_split_query(_mode))  # fmt: skip
query(f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN nth <= least(greatest(1, round_even(0.2 * total, 0)), total - 1) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY
    md5('{_SEED}|' || l_orderkey || '|' || l_linenumber || '|' || l_suppkey || '|' || l_partkey)) AS nth FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem))""", "cold_split_random")(_split_query("random"))  # fmt: skip


def _permuted_sql(v: str, seed: int) -> str:
    """The SQL of ``hashing.permuted`` for one step, with ``rows`` and ``cols`` as columns."""
    mixed = lambda x, k: f"('0x' || substr(md5('{seed}|{k}|' || ({x})), 1, 13))::BIGINT"
    left, right = f"({v} // cols)", f"({v} % cols)"
    for k in range(2):
        left = f"(({left} + {mixed(right, 2 * k)}) % rows)"
        right = f"(({right} + {mixed(left, 2 * k + 1)}) % cols)"
    return f"({left} * cols + {right})"


@query(f"""WITH RECURSIVE known AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
s AS (SELECT l_suppkey, row_number() OVER (ORDER BY substr(md5('7|' || l_suppkey), 1, 13), l_suppkey) AS d FROM (SELECT DISTINCT l_suppkey FROM known)),
p AS (SELECT l_partkey, row_number() OVER (ORDER BY substr(md5('8|' || l_partkey), 1, 13), l_partkey) AS t FROM (SELECT DISTINCT l_partkey FROM known)),
others AS (SELECT l_suppkey, l_partkey, row_number() OVER (ORDER BY d, t) - 1 AS r FROM (SELECT * FROM s, p) ANTI JOIN known USING (l_suppkey, l_partkey)),
size AS (SELECT count(*)::BIGINT AS size, ceil(sqrt(count(*)))::BIGINT AS rows, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS cols FROM others),
walk AS (SELECT {_permuted_sql("i", 7)} AS v, size, rows, cols FROM size, (SELECT unnest(range(least(round_even(0.5 * (SELECT count(*) FROM known), 0)::BIGINT, (SELECT count(*) FROM others)))) AS i)
  UNION ALL SELECT {_permuted_sql("v", 7)}, size, rows, cols FROM walk WHERE v >= size)
SELECT l_suppkey, l_partkey, 1 AS label FROM known UNION ALL
SELECT l_suppkey, l_partkey, 0 FROM others JOIN walk ON r = v""")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.with_negatives(_pair_table(spark, sf_dir), "l_suppkey", "l_partkey", 0.5, _SEED)


@query("""SELECT s AS l_suppkey, p AS l_partkey, (EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s AND l_partkey = p))::BIGINT AS cell
FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem), (SELECT DISTINCT l_partkey AS p FROM lineitem)""")
def interaction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cells(_pair_table(spark, sf_dir), "l_suppkey", "l_partkey")


@query("""WITH known AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT s AS l_suppkey, p AS l_partkey, (l_suppkey IS NOT NULL)::BIGINT AS cell
FROM (SELECT DISTINCT l_suppkey AS s FROM known) CROSS JOIN (SELECT DISTINCT l_partkey AS p FROM known)
LEFT JOIN known ON l_suppkey = s AND l_partkey = p""")
def interaction_matrix_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``interaction_matrix``; the name is kept for those who use it."""
    return pairs.cells(_pair_table(spark, sf_dir), "l_suppkey", "l_partkey")


@query("""SELECT o_orderpriority, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS description FROM orders GROUP BY 1""")
def interaction_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.kinds(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_orderkey")


@query("""WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) AS nth FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT o_orderkey, 1 AS label FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
SELECT o_orderkey, 0 FROM ranked, n WHERE nth <= n""")
def binary_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.one_against_rest(table(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT", ("o_orderkey",), 1.0, _SEED)
    return found.select("o_orderkey", "label")


@query("SELECT count(DISTINCT v) AS n FROM (SELECT l_suppkey AS v FROM lineitem UNION ALL SELECT l_partkey FROM lineitem)")
def n_entities_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.n_entities(_pair_table(spark, sf_dir), "l_suppkey", "l_partkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 1000""")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by_hash(_pair_table(spark, sf_dir).select("l_orderkey", "l_linenumber"), 1000, _SEED, "l_orderkey", "l_linenumber")


_SQL_COMBINE = {"sum": "a + b", "product": "a * b", "absdiff": "abs(a - b)", "mean": "(a + b) / 2", "max": "greatest(a, b)"}


def _pair_feature_query(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
        other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
        made = vectors.join(other, "vec_id").select("vec_id", F.posexplode(pairs.pair_features(F.col("x"), F.col("y"), method)).alias("pos", "value"))
        return rounded(made.withColumn("pos", F.col("pos").cast("long")), "value")

    return run


_BOTH = "SELECT l.vec_id, l.embedding AS x, r.embedding AS y FROM embeddings l JOIN embeddings r ON r.vec_id = l.vec_id + 1"
for _method, _sql in _SQL_COMBINE.items():
    query(f"""SELECT vec_id, pos, round({_sql}, 6) + 0.0 AS value FROM (SELECT vec_id, unnest(range(len(x))) AS pos,
      unnest(x)::DOUBLE AS a, unnest(y)::DOUBLE AS b FROM ({_BOTH}))""", f"pair_features_{_method}")(_pair_feature_query(_method))  # fmt: skip
query(f"""SELECT vec_id, unnest(range(len(x) + len(y))) AS pos, round(unnest(list_concat(x, y))::DOUBLE, 6) + 0.0 AS value FROM ({_BOTH})""", "pair_features_concat")(_pair_feature_query("concat"))

# Cleaning ---------------------------------------------------------------------------


@query("""SELECT step_no::INTEGER AS step_no, step, n FROM (
SELECT 0 AS step_no, 'fetched' AS step, count(*) AS n FROM lineitem UNION ALL
SELECT 1, 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R' UNION ALL
SELECT 2, 'finished', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' UNION ALL
SELECT 3, 'with quantity', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 10)""")
def clean_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("fetched", F.lit(True)), ("returned", F.col("l_returnflag") == "R"), ("finished", F.col("l_linestatus") == "F"), ("with quantity", F.col("l_quantity") > 10)]
    return clean.funnel(table(spark, sf_dir, "lineitem"), steps)


def _collapse_query(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
        place = {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}  # line numbers come twice; the first row counts
        return rounded(clean.collapse(rows.withColumns(place), "l_partkey", "l_quantity", "l_returnflag", "row_id", how, ("file", "row")), "l_quantity")

    return run


for _how, _sql in {"median": "median", "mean": "avg", "min": "min", "max": "max"}.items():
    query(f"""SELECT l_partkey, arg_min(l_returnflag, l_orderkey * 100 + l_linenumber) AS l_returnflag, round({_sql}(l_quantity), 6) + 0.0 AS l_quantity,
      count(*) AS n_measurements FROM lineitem GROUP BY 1""", f"collapse_{_how}")(_collapse_query(_how))  # fmt: skip


@query("SELECT d.doc_id, d.lang, l.toxic AS y FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL")
def label_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return clean.label_task(rows, "toxic", "doc_id", "lang")


@query("SELECT o_orderkey, (o_totalprice > 150000)::INTEGER AS y FROM orders")
def pchembl_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", clean.above(F.col("o_totalprice"), 150000.0).alias("y"))


@query("SELECT l_orderkey, l_linenumber, round(-log10(l_extendedprice * 1e-9), 6) AS pkd FROM lineitem WHERE l_extendedprice > 0")
def pkd_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0")
    return rows.select("l_orderkey", "l_linenumber", F.round(clean.pkd(F.col("l_extendedprice")), 6).alias("pkd"))


# Matrices: embeddings in long form, a sample is a vector and a probe a component -----

_CELLS = "(SELECT vec_id AS sample_id, unnest(range(len(embedding))) AS probe_id, unnest(embedding)::DOUBLE AS value FROM embeddings)"
_HOLES = f"(SELECT sample_id, probe_id, CASE WHEN value >= -0.15 THEN value END AS value FROM {_CELLS})"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("probe_id", "value"))
    return rows.select("sample_id", F.col("probe_id").cast("long").alias("probe_id"), F.col("value").cast("double").alias("value"))


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).withColumn("value", F.when(F.col("value") >= -0.15, F.col("value")))


@query("SELECT l_orderkey AS sample_id, l_linenumber AS probe_id, round(log2(l_extendedprice + 1), 6) AS value FROM lineitem")
def log2_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("probe_id"), F.col("l_extendedprice").alias("value"))
    return rounded(matrix.log2_transform(cells), "value")


@query(f"""SELECT sample_id, probe_id, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END, 6) + 0.0 AS value
FROM {_CELLS} WINDOW w AS (PARTITION BY probe_id)""")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.zscore(_cells(spark, sf_dir)), "value")


@query(f"SELECT sample_id, probe_id, round(value - median(value) OVER (PARTITION BY sample_id), 6) + 0.0 AS value FROM {_CELLS}")
def median_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.median_center(_cells(spark, sf_dir)), "value")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value, probe_id) AS rn,
  rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0::DOUBLE AS rk FROM {_CELLS}),
m AS (SELECT rn, avg(value) AS level FROM r GROUP BY rn)
SELECT sample_id, probe_id, round((a.level + b.level) / 2, 6) + 0.0 AS value FROM r JOIN m a ON a.rn = floor(rk) JOIN m b ON b.rn = ceil(rk)""")
def quantile_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.quantile_normalize(_cells(spark, sf_dir)), "value")


@query(f"SELECT probe_id, round(var_samp(value), 6) AS variance FROM {_CELLS} GROUP BY 1 ORDER BY var_samp(value) DESC, probe_id LIMIT 10")
def top_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.top_variance(_cells(spark, sf_dir), 10), "variance")


for _how, _sql in {"mean": "avg", "median": "median"}.items():

    def _impute(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        return rounded(clean.impute(_holes(spark, sf_dir), "probe_id", "value", how).select(*matrix.KEYS, "value"), "value")

    query(f"SELECT sample_id, probe_id, round(coalesce(value, {_sql}(value) OVER (PARTITION BY probe_id)), 6) + 0.0 AS value FROM {_HOLES}", f"impute_{_how}")(_impute)


@query(f"""SELECT sample_id, probe_id, round(value, 6) + 0.0 AS value FROM {_HOLES} WHERE probe_id IN (
  SELECT probe_id FROM {_HOLES} GROUP BY 1 HAVING avg((value IS NULL)::INTEGER) <= 0.1)""")
def dropna_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.drop_missing(_holes(spark, sf_dir), "probe_id", "value", 0.1).select(*matrix.KEYS, "value"), "value")


# Sequences --------------------------------------------------------------------------

_PROTEIN = f"regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'ss')), '[^{sequences.RESIDUES}]', '', 'g')"


def _proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", sequences.clean_protein(F.coalesce("text", F.lit(""))).alias("s"))


@query(f"""SELECT item_id, unnest(range(20)) AS residue, round(unnest(list_transform(range(1, 21),
  lambda i: (length(s) - length(replace(s, '{sequences.RESIDUES}'[i], '')))::DOUBLE / length(s))), 6) AS share
FROM (SELECT item_id, {_PROTEIN} AS s FROM benchmark) WHERE length(s) > 0""")
def aac(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _proteins(spark, sf_dir).select("item_id", F.posexplode(sequences.aac(F.col("s"))).alias("residue", "share"))
    return rounded(made.withColumn("residue", F.col("residue").cast("long")), "share")


@query(f"""WITH p AS (SELECT item_id, {_PROTEIN} AS s FROM benchmark),
pairs AS (SELECT item_id, length(s) - 1 AS n, unnest(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS dipeptide FROM p WHERE length(s) > 1)
SELECT item_id, dipeptide, round(count(*)::DOUBLE / any_value(n), 6) AS share FROM pairs GROUP BY 1, 2""")
def dpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequences.dipeptides(_proteins(spark, sf_dir), "item_id", "s"), "share")


#: Residues by charge (positive, neutral, negative).
CHARGE = ("KR", "ANCQGHILMFPSTWYV", "DE")


@query(f"""SELECT item_id, unnest(range(3)) AS class, round(unnest([{", ".join(f"(length(s) - length(regexp_replace(s, '[{g}]', '', 'g')))::DOUBLE / length(s)" for g in CHARGE)}]), 6) AS share
FROM (SELECT item_id, {_PROTEIN} AS s FROM benchmark) WHERE length(s) > 0""")
def ctd_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _proteins(spark, sf_dir).select("item_id", F.posexplode(sequences.composition(F.col("s"), CHARGE)).alias("class", "share"))
    return rounded(made.withColumn("class", F.col("class").cast("long")), "share")


@query("""SELECT item_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS token FROM benchmark WHERE length(text) > 0""")
def tokenize_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(sequences.tokenize(F.col("text"))).alias("pos", "token"))
    return made.withColumn("pos", F.col("pos").cast("long"))


@query("""WITH t AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark WHERE length(text) > 0)
SELECT 'E' AS token, 0 AS index UNION ALL SELECT '!', 1 UNION ALL SELECT '?', 2 UNION ALL
SELECT token, row_number() OVER (ORDER BY token) + 2 FROM t WHERE token NOT IN ('E', '!', '?')""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.vocabulary(table(spark, sf_dir, "benchmark").select(sequences.tokenize(F.col("text")).alias("t")), "t")


_ATOMS_SQL = sequences.ATOMS.replace("'", "''")


@query(f"""SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '{_ATOMS_SQL}', 1) AS t FROM documents) WHERE len(t) > 0""")
def tokenize_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sequences.tokenize(F.col("text"), "atom")).alias("pos", "token"))
    return made.withColumn("pos", F.col("pos").cast("long"))


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int], int]:
    """Tokens of the texts, the vocabulary (a bounded alphabet) and the length of sequences."""
    rows = table(spark, sf_dir, "benchmark").where("length(text) > 0").select("item_id", sequences.tokenize(F.col("text")).alias("t"))
    known = {r.token: r["index"] for r in sequences.vocabulary(rows, "t").collect()}
    return rows, known, rows.agg(F.max(F.size("t"))).first()[0] + 5


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    rows, known, length = _fitted(spark, sf_dir)
    index = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return rows.select("item_id", sequences.encode(F.col("t"), index, length).alias("codes")), known


_VOCABULARY = """v AS (WITH t AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark WHERE length(text) > 0)
SELECT 'E' AS token, 0 AS code UNION ALL SELECT '!', 1 UNION ALL SELECT '?', 2 UNION ALL
SELECT token, row_number() OVER (ORDER BY token) + 2 FROM t WHERE token NOT IN ('E', '!', '?'))"""
_LENGTH = "(SELECT max(length(text)) + 5 FROM benchmark)"


@query(f"""WITH {_VOCABULARY}, s AS (SELECT item_id, length(text) AS n, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS token FROM benchmark WHERE length(text) > 0)
SELECT item_id, pos, code::INTEGER AS code FROM s JOIN v USING (token)
UNION ALL SELECT item_id, 0, 1 FROM benchmark WHERE length(text) > 0
UNION ALL SELECT item_id, unnest(range(length(text) + 1, {_LENGTH})), 0 FROM benchmark WHERE length(text) > 0""")
def vectorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _codes(spark, sf_dir)[0].select("item_id", F.posexplode("codes").alias("pos", "code"))
    return made.withColumn("pos", F.col("pos").cast("long"))


@query("SELECT item_id, replace(replace(text, 'E', ''), '!', '') AS text FROM benchmark WHERE length(text) > 0")
def inverse_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through codes and ones and back; start and end tokens go, as they do from any sequence."""
    rows, known = _codes(spark, sf_dir)
    token = F.create_map(*[x for t, i in known.items() for x in (F.lit(i).cast("long"), F.lit(t))])
    marks = sequences.one_hot(F.col("codes"), len(known))
    return rows.select("item_id", sequences.decode(sequences.from_one_hot(marks), token).alias("text"))


def _ctd_sql() -> str:
    parts = []
    for groups in sequences.GROUPS.values():
        g = f"string_split(translate(s, '{''.join(groups)}', '{''.join(str(k) * len(x) for k, x in enumerate(groups, 1))}'), '')"
        values = [f"len(list_filter(g, lambda c: c = '{k}'))::DOUBLE / n" for k in "123"]
        values += [f"len(list_filter(range(1, n), lambda i: (g[i] = '{a}' AND g[i + 1] = '{b}') OR (g[i] = '{b}' AND g[i + 1] = '{a}')))::DOUBLE / greatest(n - 1, 1)" for a, b in ("12", "13", "23")]
        for k in "123":
            at = f"list_filter(range(1, n + 1), lambda i: g[i] = '{k}')"
            values += [f"coalesce(({at})[greatest(ceil({p / 100}::DOUBLE * len({at})), 1)::BIGINT]::DOUBLE / n * 100, 0)" for p in sequences.FRACTIONS]
        parts.append(f"(SELECT item_id, [{', '.join(values)}] AS v FROM (SELECT item_id, length(s) AS n, {g} AS g FROM p))")
    joined = " JOIN ".join(f"{part} t{k}" + ("" if not k else " USING (item_id)") for k, part in enumerate(parts))
    whole = " || ".join(f"t{k}.v" for k in range(len(parts)))
    return f"""WITH p AS (SELECT item_id, s FROM (SELECT item_id, {_PROTEIN} AS s FROM benchmark) WHERE length(s) > 0)
SELECT item_id, unnest({sequences.ctd_names()}) AS feature, round(unnest({whole}), 6) AS value FROM {joined}"""


@query(_ctd_sql())
def ctd(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sequences.featurized(table(spark, sf_dir, "benchmark"), "text", "ctd").select("item_id", F.posexplode("features").alias("pos", "value"))
    names = F.array(*map(F.lit, sequences.ctd_names()))
    return rounded(made.select("item_id", F.get(names, F.col("pos")).alias("feature"), "value"), "value")


# Metrics and Pareto fronts ----------------------------------------------------------

_JUDGED = "(SELECT l.toxic AS y, d.n_chars AS score, (d.n_chars > 2000)::INTEGER AS predicted FROM labels l JOIN documents d USING (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("toxic").alias("y"), F.col("n_chars").alias("score"), (F.col("n_chars") > 2000).cast("int").alias("predicted"))


@query(f"""SELECT round(avg((y = predicted)::INTEGER), 6) AS accuracy, round(2 * count(*) FILTER (y = 1 AND predicted = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (predicted = 1))::DOUBLE, 6) AS f1,
round((count(*) FILTER (y = 1 AND predicted = 1) / count(*) FILTER (y = 1)::DOUBLE + count(*) FILTER (y = 0 AND predicted = 0) / count(*) FILTER (y = 0)::DOUBLE) / 2, 6) AS balanced FROM {_JUDGED}""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _judged(spark, sf_dir).agg(
        metrics.accuracy("y", "predicted").alias("accuracy"), metrics.f1("y", "predicted").alias("f1"), metrics.balanced_accuracy("y", "predicted").alias("balanced")
    )
    return rounded(found, "accuracy", "f1", "balanced")


@query(f"""SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 6) AS auc
FROM (SELECT y, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::DOUBLE AS r FROM {_JUDGED})""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(_judged(spark, sf_dir), "y", "score"), "auc")


_POINTS = "(SELECT l_partkey AS id, avg(l_quantity) AS f1, -count(*) AS f2 FROM lineitem GROUP BY 1)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg("l_quantity").alias("f1"), (-F.count(F.lit(1))).alias("f2"))


@query(f"""WITH p AS {_POINTS} SELECT round(f1, 6) AS f1, f2, min(id) AS id FROM p
WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.f1 <= p.f1 AND q.f2 <= p.f2 AND (q.f1 < p.f1 OR q.f2 < p.f2)) GROUP BY p.f1, f2""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pareto.front_of_two(_points(spark, sf_dir), "f1", "f2", "id"), "f1")


@query("""WITH p AS (SELECT s_suppkey AS id, s_suppkey // 64 AS front, s_acctbal AS f1, (s_suppkey % 7)::DOUBLE AS f2 FROM supplier),
g AS (SELECT *, lead(f1) OVER a - lag(f1) OVER a AS g1, lead(f2) OVER b - lag(f2) OVER b AS g2, max(f1) OVER w - min(f1) OVER w AS s1, max(f2) OVER w - min(f2) OVER w AS s2
  FROM p WINDOW a AS (PARTITION BY front ORDER BY f1, id), b AS (PARTITION BY front ORDER BY f2, id), w AS (PARTITION BY front))
SELECT id, front, CASE WHEN g1 IS NULL OR g2 IS NULL THEN -1 ELSE round(CASE WHEN s1 = 0 THEN 0 ELSE g1 / s1 END + CASE WHEN s2 = 0 THEN 0 ELSE g2 / s2 END, 6) END AS crowding FROM g""")
def crowding_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinite distances as -1, for comparison."""
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 64).cast("long").alias("front"), F.col("s_acctbal").alias("f1"), (F.col("s_suppkey") % 7).cast("double").alias("f2"))
    found = pareto.crowding_distance(points, ["f1", "f2"], "id", "front").select("id", "front", "crowding")
    return found.withColumn("crowding", F.when(F.col("crowding") == float("inf"), F.lit(-1.0)).otherwise(F.round("crowding", 6)))


_CUSTOMERS = "(SELECT c_custkey AS id, c_custkey // 64 AS run, round(c_acctbal, 2)::DOUBLE AS f1, (c_custkey * 37 % 101)::DOUBLE AS f2, (c_custkey * 53 % 17)::DOUBLE AS f3 FROM customer)"
_RANKED = f"""p AS {_CUSTOMERS},
peeled AS (SELECT id, run, 0 AS front FROM p UNION SELECT q.id, q.run, r.front + 1 FROM peeled r JOIN p a ON a.id = r.id JOIN p q ON q.run = a.run
  AND a.f1 <= q.f1 AND a.f2 <= q.f2 AND a.f3 <= q.f3 AND (a.f1 < q.f1 OR a.f2 < q.f2 OR a.f3 < q.f3)),
numbered AS (SELECT p.*, f.front FROM p JOIN (SELECT id, max(front)::BIGINT AS front FROM peeled GROUP BY 1) f USING (id))"""


def _customers(spark: SparkSession, sf_dir: str, run: Column | None = None) -> DataFrame:
    key = F.col("c_custkey")
    run = F.floor(key / 64).cast("long") if run is None else run
    more = [F.round("c_acctbal", 2).cast("double").alias("f1"), (key * 37 % 101).cast("double").alias("f2"), (key * 53 % 17).cast("double").alias("f3")]
    return table(spark, sf_dir, "customer").select(key.alias("id"), run.alias("run"), *more)


@query(f"WITH RECURSIVE {_RANKED} SELECT id, run, front FROM numbered")
def non_dominated_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fronts of populations of 64 customers each."""
    return pareto.front_numbers(_customers(spark, sf_dir), ["f1", "f2", "f3"], "id", "run").select("id", "run", "front")


_BY_NATION = _RANKED.replace("c_custkey // 64 AS run", "c_nationkey::BIGINT AS run")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation as a population, which grows with the table."""
    return _customers(spark, sf_dir, F.col("c_nationkey").cast("long"))


_GAPS = ", ".join(f"lead(f{k}) OVER o{k} - lag(f{k}) OVER o{k} AS g{k}, max(f{k}) OVER w - min(f{k}) OVER w AS s{k}" for k in (1, 2, 3))
_ORDERS = ", ".join(f"o{k} AS (PARTITION BY run, front ORDER BY f{k}, id)" for k in (1, 2, 3))
_CROWD = " + ".join(f"CASE WHEN g{k} IS NULL THEN 'Infinity'::DOUBLE WHEN s{k} = 0 THEN 0 ELSE g{k} / s{k} END" for k in (1, 2, 3))


@query(f"""WITH RECURSIVE {_BY_NATION}, gaps AS (SELECT *, {_GAPS} FROM numbered WINDOW w AS (PARTITION BY run, front), {_ORDERS})
SELECT id, run, front, row_number() OVER (PARTITION BY run ORDER BY front, {_CROWD} DESC, id) AS place FROM gaps""")
def pareto_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pareto.pareto_order(_nations(spark, sf_dir), ["f1", "f2", "f3"], "id", "run", large=True)
    return found.select("id", "run", "front", F.col("place").cast("long").alias("place"))


_THREE = "(SELECT l_partkey AS id, avg(l_quantity) AS f1, -count(*) AS f2, round(avg(l_discount), 9) AS f3 FROM lineitem GROUP BY 1)"


@query(f"""WITH p AS {_THREE} SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.f1 <= p.f1 AND q.f2 <= p.f2 AND q.f3 <= p.f3
  AND (q.f1 < p.f1 OR q.f2 < p.f2 OR q.f3 < p.f3))""")
def pareto_front_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"))
    points = rows.agg(F.avg("l_quantity").cast("double").alias("f1"), (-F.count(F.lit(1))).alias("f2"), F.round(F.avg("l_discount"), 9).cast("double").alias("f3"))
    return pareto.front(points, ["f1", "f2", "f3"], "id").select("id")


@query("SELECT toxic::BIGINT AS toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels WHERE toxic IS NOT NULL)::DOUBLE, 6) AS share FROM labels WHERE toxic IS NOT NULL GROUP BY 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.class_counts(table(spark, sf_dir, "labels").withColumn("toxic", F.col("toxic").cast("long")), "toxic"), "share")


# Objectives and search --------------------------------------------------------------

_X = "list_transform(embedding, lambda v: v::DOUBLE)"
_BENCHMARKS = {
    "sphere": (objectives.sphere, "list_sum(list_transform(x, lambda v: v * v))"),
    "rastrigin": (objectives.rastrigin, "10 * len(x) + list_sum(list_transform(x, lambda v: v * v - 10 * cos(2 * pi() * v)))"),
    "ackley": (objectives.ackley, "-20 * exp(-0.2::DOUBLE * sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))) - exp(list_sum(list_transform(x, lambda v: cos(2 * pi() * v))) / len(x)) + 20 + exp(1::DOUBLE)"),
}
for _name, (_objective, _sql) in _BENCHMARKS.items():

    def _benchmark(spark: SparkSession, sf_dir: str, objective=_objective) -> DataFrame:
        return table(spark, sf_dir, "embeddings").select("vec_id", F.round(objective(F.col("embedding").cast("array<double>")), 6).alias("f"))

    query(f"SELECT vec_id, round({_sql}, 6) AS f FROM (SELECT vec_id, {_X} AS x FROM embeddings)", f"benchmark_{_name}")(_benchmark)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.least(F.greatest((v + 0.5), F.lit(0.0)), F.lit(1.0)))
    return table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"), (F.col("label") < 5).cast("int").alias("y"))


_CANDIDATES = [(k, [float((i * (k + 1)) % 11 - 2) for i in range(64)]) for k in range(5)]


@query(f"""WITH m AS (SELECT list_transform(embedding, lambda v: least(greatest(v::DOUBLE + 0.5, 0), 1)) AS p, (label < 5)::INTEGER AS y FROM embeddings),
c AS (SELECT * FROM (VALUES {", ".join(f"({k}, [{', '.join(str(max(v, 0.0)) for v in x)}]::DOUBLE[])" for k, x in _CANDIDATES)}) t(cand_id, w))
SELECT cand_id::BIGINT AS cand_id, round(1 - avg(((list_inner_product(p, w) / list_sum(w) > 0.5)::INTEGER = y)::INTEGER), 6) AS fitness FROM m, c GROUP BY 1""")
def ensemble_fitness_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = spark.createDataFrame(_CANDIDATES, "cand_id long, x array<double>")
    found = objectives.ensemble_errors(_members(spark, sf_dir), batch)
    return rounded(found.withColumn("cand_id", F.col("cand_id").cast("long")), "fitness")


@query("""WITH n AS (SELECT greatest(1, least(count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0))) AS keep FROM labels),
c AS (SELECT range AS cand_id FROM range(4))
SELECT cand_id, row_id FROM (SELECT cand_id, doc_id AS row_id, row_number() OVER (PARTITION BY cand_id
  ORDER BY (cand_id + doc_id) % 3 = 0 DESC, md5('7|' || cand_id || '|' || doc_id), doc_id) AS nth FROM labels, c WHERE toxic = 0), n WHERE nth <= keep""")
def undersample_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidates, each with a bit for every row of the majority class."""
    rows = table(spark, sf_dir, "labels")
    n = rows.agg(F.count_if(F.col("toxic") == 1).alias("minority"), F.count_if(F.col("toxic") == 0).alias("majority")).first()
    bits = rows.where("toxic = 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cand_id"), F.col("doc_id").alias("row_id"))
    bits = bits.withColumn("bit", ((F.col("cand_id") + F.col("row_id")) % 3 == 0).cast("int"))
    return objectives.undersample_repair(bits, objectives.kept_majority(n.minority, n.majority), _SEED).select("cand_id", "row_id")


_C_VALUES = ", ".join(f"({k}, [{', '.join(str(max(v, 0.0)) for v in x)}]::DOUBLE[])" for k, x in _CANDIDATES)
_VOTES = f"""(WITH m AS (SELECT list_transform(embedding, lambda v: least(greatest(v::DOUBLE + 0.5, 0), 1)) AS p, (label < 5)::INTEGER AS y FROM embeddings),
c AS (SELECT cand_id, list_transform(w, lambda v: v / list_sum(w)) AS w FROM (VALUES {_C_VALUES}) t(cand_id, w))
SELECT cand_id::BIGINT AS cand_id, y, round(list_inner_product(p, w), 9) AS score FROM m, c)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = objectives.ensemble_scores(_members(spark, sf_dir), spark.createDataFrame(_CANDIDATES, "cand_id long, x array<double>"))
    return scored.withColumn("score", F.round("score", 9))


@query(f"""SELECT cand_id, round(2 * count(*) FILTER (y = 1 AND score > 0.5) / (count(*) FILTER (y = 1) + count(*) FILTER (score > 0.5))::DOUBLE, 6) AS f1 FROM {_VOTES} GROUP BY 1""")
def ensemble_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = objectives.ensemble_errors(_members(spark, sf_dir), spark.createDataFrame(_CANDIDATES, "cand_id long, x array<double>"), metric="f1")
    return rounded(found.select("cand_id", (1 - F.col("fitness")).alias("f1")), "f1")


@query(f"""SELECT cand_id, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 6) AS auc
FROM (SELECT cand_id, y, (rank() OVER (PARTITION BY cand_id ORDER BY score) + (count(*) OVER (PARTITION BY cand_id, score) - 1) / 2.0)::DOUBLE AS r FROM {_VOTES}) GROUP BY 1""")
def ensemble_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc(_votes(spark, sf_dir), "y", "score", ("cand_id",)), "auc")


@query("""SELECT label::BIGINT AS label, unnest(range(64)) AS pos, round(unnest(list_transform(range(64), lambda j: list_sum(list_transform(xs, lambda r: r.w * r.x[j + 1])) / list_sum(list_transform(xs, lambda r: r.w)))), 6) + 0.0 AS value
FROM (SELECT label, list({'w': (vec_id % 7 + 1)::DOUBLE, 'x': list_transform(embedding, lambda v: v::DOUBLE)}) AS xs FROM embeddings GROUP BY 1)""")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 7 + 1).alias("w"))
    found = objectives.weighted_centroid(rows, "x", "w", "label").select("label", F.posexplode("centroid").alias("pos", "value"))
    return rounded(found.withColumn("pos", F.col("pos").cast("long")), "value")


@query("SELECT vec_id, unnest(list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0.1::FLOAT)) AS feature FROM embeddings")
def feature_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = objectives.selected(F.col("embedding"), F.lit(0.1).cast("float"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(mask).alias("feature")).withColumn("feature", F.col("feature").cast("long"))


_RUN = "SELECT event_id, user_id, row_number() OVER w AS iter, min(value) OVER (w ROWS UNBOUNDED PRECEDING) AS best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(_RUN)
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.running_best(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "iter", "best")


@query(f"""WITH b AS (SELECT *, coalesce((best < lag(best) OVER (PARTITION BY user_id ORDER BY iter))::INTEGER, 1) AS better FROM ({_RUN})),
s AS (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY iter)::BIGINT AS stall FROM b),
l AS (SELECT user_id, stall, count(*) - 1 AS length FROM s GROUP BY 1, 2)
SELECT * FROM (SELECT *, stall = max(stall) OVER (PARTITION BY user_id) AS tail FROM l) WHERE length > 0 OR tail""")
def stall_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = clean.running_best(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return clean.stall_lengths(series, "user_id").select("user_id", F.col("stall").cast("long").alias("stall"), "length", "tail")


@query(f"""WITH RECURSIVE r AS ({_RUN}),
f AS (SELECT user_id, 0::BIGINT AS iter, 'Infinity'::DOUBLE AS least, 0::BIGINT AS stalled, 0::BIGINT AS ended, false AS cut, 0::BIGINT AS had FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT f.user_id, r.iter, CASE WHEN r.best < f.least - 5 THEN r.best ELSE f.least END, CASE WHEN r.best < f.least - 5 THEN 0 ELSE f.stalled + 1 END,
    f.ended + (r.best < f.least - 5 AND f.stalled > 0)::BIGINT, r.best < f.least - 5 AND f.stalled > 0, f.stalled
  FROM f JOIN r ON r.user_id = f.user_id AND r.iter = f.iter + 1)
SELECT user_id, ended - 1 AS stall, had AS length, false AS tail FROM f WHERE cut
UNION ALL SELECT user_id, ended, stalled, true FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iter DESC) AS back FROM f) WHERE back = 1""")
def stall_lengths_min_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = clean.running_best(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return clean.stalls_beyond(series, "user_id", 5.0).select("user_id", "stall", "length", "tail")


def _swarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 32).cast("long").alias("run"), F.col("vec_id").alias("id"), x.alias("x"))
    return rows.withColumn("f", F.round(objectives.sphere(F.col("x")), 9))


_SWARM = "(SELECT vec_id // 32 AS run, vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 9) AS f FROM embeddings)"


@query(f"""WITH p AS {_SWARM}, c AS (SELECT 1.0::DOUBLE - (1.0::DOUBLE - 0.00004::DOUBLE) * 0.25::DOUBLE AS c),
b AS (SELECT run, arg_min(x, {{'f': f, 'id': id}}) AS best FROM p GROUP BY 1),
d AS (SELECT i.run, i.id, i.x AS xi, j.x AS xj, i.id = j.id AS own, sqrt(list_sum(list_transform(list_zip(i.x, j.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM p i JOIN p j ON i.run = j.run),
s AS (SELECT *, CASE WHEN max(dist) OVER (PARTITION BY run) > 0 THEN 1 + 3 * dist / max(dist) OVER (PARTITION BY run) ELSE 1 END AS scaled FROM d),
q AS (SELECT run, id, any_value(xi) AS x, list(xj) AS xs, list(CASE WHEN own THEN 0 ELSE (0.6 * exp(-scaled / 1.5) - exp(-scaled)) / (dist + 1e-12) END) AS pull FROM s GROUP BY 1, 2)
SELECT q.run, q.id, unnest(range(64)) AS pos, round(unnest(list_transform(range(1, 65), lambda k:
  least(greatest(c * c * 5.12 * list_sum(list_transform(list_zip(xs, pull), lambda z: z[2] * (z[1][k] - x[k]))) + best[k], -5.12), 5.12))), 6) + 0.0 AS value
FROM q JOIN b USING (run), c""")
def grasshopper_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of populations of 32 vectors each."""
    moved = search.grasshopper_step(_swarm(spark, sf_dir), 1, 0.25, -5.12, 5.12, objectives.sphere)
    return rounded(moved.select("run", "id", F.posexplode("x").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")), "value")


@query(f"SELECT run, id, place FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f, id) AS place FROM {_SWARM}) WHERE place <= 5")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.truncated(_swarm(spark, sf_dir), 5).select("run", "id", F.col("place").cast("long").alias("place"))


# Selections -------------------------------------------------------------------------

_PEOPLE = "(SELECT vec_id // 32 AS run, vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, round(embedding[1]::DOUBLE, 6) AS f FROM embeddings)"
_DRAW = "((id * 37 % 101)::DOUBLE / 101)"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations of 32 vectors each, rated by their first coordinate."""
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 32).cast("long").alias("run"), F.col("vec_id").alias("id"), x.alias("x"))
    return rows.withColumn("f", F.round(F.col("x")[0], 6))


def _drawn() -> Column:
    return (F.col("id") * 37 % 101).cast("double") / 101.0


@query(f"SELECT run, id, place FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f DESC, id DESC) AS place FROM {_PEOPLE}) WHERE place <= 5")
def worst_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.worst(_people(spark, sf_dir), 5).select("run", "id", F.col("place").cast("long").alias("place"))


@query(f"""WITH RECURSIVE {_BY_NATION}, gaps AS (SELECT *, {_GAPS} FROM numbered WINDOW w AS (PARTITION BY run, front), {_ORDERS})
SELECT * FROM (SELECT id, run, front, row_number() OVER (PARTITION BY run ORDER BY front, {_CROWD} DESC, id) AS place FROM gaps) WHERE place <= 20""")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.survivors(_nations(spark, sf_dir), ["f1", "f2", "f3"], "id", "run", 20, large=True)
    return found.select("id", "run", "front", F.col("place").cast("long").alias("place"))


@query(f"""WITH gaps AS (SELECT *, {_GAPS} FROM {_CUSTOMERS} WINDOW w AS (PARTITION BY run), {_ORDERS.replace("run, front", "run")})
SELECT id, run, row_number() OVER (PARTITION BY run ORDER BY id) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {_CROWD} DESC, id) AS nth FROM gaps) WHERE nth <= 20""")
def archive_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.capped(_customers(spark, sf_dir), ["f1", "f2", "f3"], "id", "run", 20)
    return found.select("id", "run", F.col("place").cast("long").alias("place"))


@query(f"""WITH r AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY f, id) - 1 AS k, count(*) OVER (PARTITION BY run) AS n FROM {_PEOPLE}),
w AS (SELECT run, id, exp(-power(k / (0.1::DOUBLE * n), 2) / 2) AS w FROM r)
SELECT run, id, round(w / sum(w) OVER (PARTITION BY run), 6) + 0.0 AS weight FROM w""")
def rank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.rank_weights(_people(spark, sf_dir)).select("run", "id", "weight"), "weight")


@query(f"""WITH p AS (SELECT *, (count(*) OVER (PARTITION BY run) - row_number() OVER (PARTITION BY run ORDER BY f, id) + 1)::DOUBLE AS weight FROM {_PEOPLE}),
e AS (SELECT run, id, sum(weight) OVER (PARTITION BY run ORDER BY id) AS "end", sum(weight) OVER (PARTITION BY run) AS total FROM p),
d AS (SELECT run, id AS draw, {_DRAW} AS u FROM p)
SELECT d.run, draw, min(e.id) AS id FROM d JOIN e ON d.run = e.run AND e."end" > u * total GROUP BY 1, 2""")
def roulette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as individuals; the better the rank, the larger the share."""
    people, run = _people(spark, sf_dir), Window.partitionBy("run")
    weight = F.count(F.lit(1)).over(run) - F.row_number().over(run.orderBy("f", "id")) + 1
    return selection.roulette(people.withColumn("weight", weight.cast("double")), people.select("run", F.col("id").alias("draw"), _drawn().alias("u")))


@query(f"SELECT run, id % 8 AS tournament, arg_min(id, {{'f': f, 'id': id}}) AS id FROM {_PEOPLE} GROUP BY 1, 2")
def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    return selection.winners(people, people.select("run", (F.col("id") % 8).alias("tournament"), "id"))


@query(f"""WITH p AS {_PEOPLE}, d AS (SELECT i.run, i.id, j.id AS other, sqrt(list_sum(list_transform(list_zip(i.x, j.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM p i JOIN p j ON i.run = j.run AND i.id <> j.id),
r AS (SELECT *, 0.97::DOUBLE * sum(d) OVER w / (count(*) OVER w + 1) AS radius FROM d WINDOW w AS (PARTITION BY run, id))
SELECT run, id, round(any_value(radius), 6) + 0.0 AS radius, count(*) FILTER (d < radius) AS n_near, arg_min(other, {{'d': d, 'id': other}}) AS nearest FROM r GROUP BY 1, 2""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone's radius, how many of its run lie within, and the nearest."""
    found = selection.neighbours(_people(spark, sf_dir), 0.97)
    return rounded(found.select("run", "id", "radius", F.size("near").cast("long").alias("n_near"), F.get("others", F.lit(0)).id.alias("nearest")), "radius")


@query(f"""WITH RECURSIVE {_BY_NATION}, z AS (SELECT id, run, f2 / max(f2) OVER (PARTITION BY run) AS u, f1 AS v FROM numbered WHERE front = 0),
c AS (SELECT run, arg_min({{'u': u, 'v': v}}, {{'u': u, 'v': v, 'id': id}}) AS a, arg_max({{'u': u, 'v': v}}, {{'u': u, 'v': v, 'id': id}}) AS b FROM z GROUP BY 1),
o AS (SELECT z.*, coalesce(round(abs((b.u - a.u) * (v - a.v) - (b.v - a.v) * (z.u - a.u)) / nullif(sqrt((b.u - a.u) * (b.u - a.u) + (b.v - a.v) * (b.v - a.v)), 0), 9), 0) AS o FROM z JOIN c USING (run))
SELECT run, arg_min(id, {{'o': -o, 'u': u, 'v': v, 'id': id}}) AS id FROM o GROUP BY 1""")
def knees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knee of each nation's first front."""
    points = _nations(spark, sf_dir)
    first = pareto.fronts_in_blocks(points, ["f1", "f2", "f3"], "id", "run").where(F.col("front") == 0)
    return selection.knees(points.join(first, ["run", "id"]), "f2", "f1", "id", "run").select("run", "id")


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: least(abs(v::DOUBLE), 1)) AS x FROM embeddings),
g AS (SELECT vec_id, x[1] AS f1, 1 + 9 * list_avg(x[2:]) AS g FROM x) SELECT vec_id, round(f1, 6) + 0.0 AS f1, round(g * (1 - sqrt(f1 / g)), 6) + 0.0 AS f2 FROM g""")
def zdt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.least(F.abs(v), F.lit(1.0)))
    found = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")).select("vec_id", objectives.zdt1(F.col("x")).alias("f"))
    return rounded(found.select("vec_id", F.col("f.f1").alias("f1"), F.col("f.f2").alias("f2")), "f1", "f2")


@query("""WITH s AS (SELECT power(gamma(2.5) * sin(pi() * 0.75) / (gamma(1.25) * 1.5 * power(2, 0.25)), 1 / 1.5) AS sigma)
SELECT vec_id, round(sigma * embedding[1]::DOUBLE / power(abs(embedding[2]::DOUBLE), 1 / 1.5), 6) + 0.0 AS step FROM embeddings, s""")
def levy_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", objectives.levy_step(x[0], x[1]).alias("step")), "step")


@query(f"""SELECT run, id, later < f OR {_DRAW} < exp(-(later - f) / 0.05) AS accepted
FROM (SELECT *, lead(f) OVER (PARTITION BY run ORDER BY id) AS later FROM {_PEOPLE}) WHERE later IS NOT NULL""")
def metropolis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each individual as a proposal to the one before it."""
    people = _people(spark, sf_dir).withColumn("later", F.lead("f").over(Window.partitionBy("run").orderBy("id"))).where(F.col("later").isNotNull())
    return people.select("run", "id", objectives.accepted(F.col("f"), F.col("later"), F.lit(0.05), _drawn()).alias("accepted"))


# Activities of a target: lines of orders as records --------------------------------------

_RECORDS = """(SELECT 'M' || l_partkey AS molecule_chembl_id, CASE WHEN l_linenumber < 7 THEN 'C' || l_partkey END AS canonical_smiles,
  CASE l_returnflag WHEN 'A' THEN '>' ELSE '=' END AS standard_relation, CASE l_linestatus WHEN 'F' THEN 'nM' ELSE 'uM' END AS standard_units,
  CASE WHEN l_discount > 0 THEN l_quantity / 10 END AS pchembl_value FROM lineitem)"""
_EXACT = "canonical_smiles IS NOT NULL AND standard_relation = '='"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("M"), part).alias("molecule_chembl_id"), F.when(F.col("l_linenumber") < 7, F.concat(F.lit("C"), part)).alias("canonical_smiles"),
        F.when(F.col("l_returnflag") == "A", ">").otherwise("=").alias("standard_relation"), F.when(F.col("l_linestatus") == "F", "nM").otherwise("uM").alias("standard_units"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity") / 10).alias("pchembl_value"),
    )


@query(f"""SELECT molecule_chembl_id, any_value(canonical_smiles) AS smiles, round(median(pchembl_value), 6) + 0.0 AS pchembl, count(*) AS n_measurements FROM {_RECORDS}
WHERE {_EXACT} AND standard_units = 'nM' AND pchembl_value IS NOT NULL GROUP BY 1""")
def activity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(activities.target_table(_records(spark, sf_dir))[0], "pchembl")


@query(f"""SELECT unnest(range(6))::INTEGER AS step_no, unnest(['records fetched', 'with SMILES', 'relation ''=''', 'units ''nM''', 'with pChEMBL', 'unique molecules']) AS step,
unnest([count(*), count(canonical_smiles), count(*) FILTER ({_EXACT}), count(*) FILTER ({_EXACT} AND standard_units = 'nM'),
  count(*) FILTER ({_EXACT} AND standard_units = 'nM' AND pchembl_value IS NOT NULL),
  count(DISTINCT molecule_chembl_id) FILTER ({_EXACT} AND standard_units = 'nM' AND pchembl_value IS NOT NULL)]) AS n FROM {_RECORDS}""")
def activity_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activities.target_table(_records(spark, sf_dir))[1]


# Selection of features by the vote of nearest neighbours ---------------------------------

_N_FOLDS, _K = 5, 5
_SUBSETS = [(k, [float((i * (k + 3)) % 7) / 7 if k else 0.0 for i in range(64)]) for k in range(4)]
_SUBSET_VALUES = ", ".join(f"({k}, {[i + 1 for i, v in enumerate(x) if v > 0.5]}::BIGINT[])" for k, x in _SUBSETS)
_SAMPLES = f"""s AS (SELECT vec_id AS id, (label < 5)::BIGINT AS label, list_transform(embedding, lambda v: floor(v::DOUBLE * 256)) AS x FROM embeddings),
sizes AS (SELECT label, count(*) AS n FROM s GROUP BY 1),
spots AS (SELECT label, unnest(range(base, base + n)) % {_N_FOLDS} AS f FROM (SELECT *, (sum(n) OVER (ORDER BY label) - n)::BIGINT AS base FROM sizes)),
ends AS (SELECT label, f, sum(count(*)) OVER (PARTITION BY label ORDER BY f) AS e FROM spots GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS r FROM s),
dealt AS (SELECT id, any_value(ranked.label) AS label, any_value(x) AS x, count(*) FILTER (e <= r) AS fold FROM ranked JOIN ends ON ends.label = ranked.label GROUP BY id)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * 256).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("long").alias("label"), x.alias("x"))


@query(f"WITH {_SAMPLES} SELECT id, label, fold FROM dealt")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.stratified(_samples(spark, sf_dir).select("id", "label"), _N_FOLDS)
    return found.select("id", "label", F.col("fold").cast("long").alias("fold"))


_NEAREST = f"""c AS (SELECT * FROM (VALUES {_SUBSET_VALUES}) t(cand_id, features)),
apart AS (SELECT c.cand_id, a.id, a.label AS y, a.fold, b.id AS other, b.label, list_sum(list_transform(c.features, lambda f: (a.x[f] - b.x[f]) * (a.x[f] - b.x[f]))) AS d
  FROM dealt a JOIN dealt b ON a.fold <> b.fold JOIN c ON len(c.features) > 0),
near AS (SELECT *, row_number() OVER (PARTITION BY cand_id, id ORDER BY d, other) AS place FROM apart QUALIFY place <= {_K})"""


@query(f"WITH {_SAMPLES}, {_NEAREST} SELECT cand_id::BIGINT AS cand_id, id, place, other, d FROM near")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of other folds by each of several subsets of the features."""
    masks = [(k, [i for i, v in enumerate(x) if v > 0.5]) for k, x in _SUBSETS]
    candidates = spark.createDataFrame([m for m in masks if m[1]], "cand_id long, features array<int>")
    found = nearest.neighbours_of(nearest.stratified(_samples(spark, sf_dir), _N_FOLDS), candidates, _K)
    return found.select("cand_id", "id", F.col("place").cast("long").alias("place"), "other", "d")


@query(f"""WITH {_SAMPLES}, {_NEAREST}, votes AS (SELECT cand_id, id, fold, y, label, count(*) AS n FROM near GROUP BY ALL),
predicted AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY cand_id, id ORDER BY n DESC, label) = 1),
folds AS (SELECT cand_id, fold, avg((y = label)::INTEGER) AS s FROM predicted GROUP BY 1, 2),
scores AS (SELECT cand_id, avg(s) AS score FROM folds GROUP BY 1)
SELECT c.cand_id::BIGINT AS cand_id, len(features)::BIGINT AS n_selected, round(score, 6) + 0.0 AS score,
  CASE WHEN len(features) = 0 THEN 1.0 ELSE round(0.99 * (1 - score) + 0.01 * len(features) / 64, 6) END::DOUBLE AS fitness FROM c LEFT JOIN scores USING (cand_id)""")
def feature_selection_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.feature_selection_fitness(_samples(spark, sf_dir), spark.createDataFrame(_SUBSETS, "cand_id long, x array<double>"), _N_FOLDS, _K)
    return rounded(found, "score", "fitness")


# Steps and searches of populations of 32 vectors each; draws are md5 of their names -----

_STEPS = search.STEPS | {"particle_swarm": swarm.particle_swarm_step, "gravitation": swarm.gravitation_step} | flight.STEPS


def _u(*parts: str, iteration: int = 1) -> str:
    """The SQL of ``search.uniform`` with seed 0."""
    return f"(('0x' || substr(md5(concat_ws('|', '0', '{iteration}', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 13))::BIGINT / {1 << 52}::DOUBLE)"


def _step_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        moved = _STEPS[name](_swarm(spark, sf_dir), 1, 0.25, -5.12, 5.12, objectives.sphere)
        return rounded(moved.select("run", "id", F.posexplode("x").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")), "value")

    return run


def _moved_sql(rows: str, value: str) -> str:
    """Positions after a step, inside the box; ``value`` of coordinate ``j``, from 0, of ``rows``."""
    return f"SELECT run, id, unnest(range(64)) AS pos, round(unnest(list_transform(range(64), lambda j: least(greatest({value}, -5.12), 5.12))), 6) + 0.0 AS value FROM {rows}"


def _wolf(k: int) -> str:
    to = f"l[{k + 1}][j + 1]"
    return f"({to} - 1.5 * (2 * {_u('run', 'id', 'j', str(2 * k))} - 1) * abs(2 * {_u('run', 'id', 'j', str(2 * k + 1))} * {to} - x[j + 1]))"


_LEADERS = f"p AS {_SWARM}, b AS (SELECT run, list(x ORDER BY f, id)[1:3] AS l FROM p GROUP BY 1), w AS (SELECT p.*, l FROM p JOIN b USING (run))"
_R = [_u("run", "id", "j", str(k)) for k in range(3)]
_WAVE = f"CASE WHEN {_R[2]} < 0.5 THEN sin(6.283185307179586 * {_R[0]}) ELSE cos(6.283185307179586 * {_R[0]}) END"
_FLIGHT = "least(greatest({v}, -{most} * 10.24), {most} * 10.24)"
_RING = f"""p AS {_SWARM}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {_u("run", "id", "'order'")}, id) - 1 AS k, count(*) OVER (PARTITION BY run) AS n FROM p),
b AS (SELECT run, arg_min(x, {{'f': f, 'id': id}}) AS best FROM p GROUP BY 1),
t AS (SELECT o.run, o.id, o.x, o.f, best, d1.x AS x1, d2.x AS x2, floor({_u("o.run", "o.id", "'gene'")} * 64)::BIGINT AS forced FROM o JOIN b USING (run)
  JOIN o d1 ON d1.run = o.run AND d1.k = (o.k + 1) % o.n JOIN o d2 ON d2.run = o.run AND d2.k = (o.k + 2) % o.n),
m AS (SELECT *, list_transform(range(64), lambda j: least(greatest(CASE WHEN {_u("run", "id", "j")} < 0.5 OR j = forced
  THEN best[j + 1] + 0.6 * (x1[j + 1] - x2[j + 1]) ELSE x[j + 1] END, -5.12), 5.12)) AS trial FROM t),
e AS (SELECT run, id, CASE WHEN list_sum(list_transform(trial, lambda v: v * v)) <= f THEN trial ELSE x END AS x FROM m)"""
_HEAVY = f"""p AS {_SWARM}, s AS (SELECT run, list({{'f': f, 'id': id, 'x': x}} ORDER BY f, id) AS s, max(f) AS worst, min(f) AS best, count(*) AS n FROM p GROUP BY 1),
m AS (SELECT *, list_transform(s, lambda a: CASE WHEN worst > best THEN (worst - a.f) / (worst - best) ELSE 1 END) AS m FROM s),
h AS (SELECT run, list_transform(range(1, greatest(1, round(n - 0.25 * (n - 1)))::BIGINT + 1), lambda i: {{'id': s[i].id, 'x': s[i].x, 'm': m[i] / list_sum(m)}}) AS h FROM m),
g AS (SELECT p.run, p.id, p.x, list_transform(h, lambda a: {{'x': a.x, 'p': CASE WHEN a.id = p.id THEN 0 ELSE {_u("p.run", "p.id", "a.id", "'pull'")} * a.m /
  (sqrt(list_sum(list_transform(list_zip(a.x, p.x), lambda z: ((z[1] - z[2]) / 10.24) * ((z[1] - z[2]) / 10.24)))) + 1e-12) END}}) AS q FROM p JOIN h USING (run))"""

for _step, _with, _rows, _value in (
    ("grey_wolf", _LEADERS, "w", f"({_wolf(0)} + {_wolf(1)} + {_wolf(2)}) / 3"),
    ("sine_cosine", _LEADERS, "w", f"x[j + 1] + 1.5 * ({_WAVE}) * abs(2 * {_R[1]} * l[1][j + 1] - x[j + 1])"),
    ("particle_swarm", _LEADERS, "w", "x[j + 1] + " + _FLIGHT.format(v=f"2 * {_R[1]} * (l[1][j + 1] - x[j + 1])", most=0.2)),
    ("differential", _RING, "e", "x[j + 1]"),
    ("gravitation", _HEAVY, "g", "x[j + 1] + " + _FLIGHT.format(v="100 * exp(-7.5::DOUBLE) * list_sum(list_transform(q, lambda a: a.p * (a.x[j + 1] - x[j + 1])))", most=0.5)),
):
    query(f"WITH {_with} {_moved_sql(_rows, _value)}", f"{_step}_step")(_step_query(_step))


_D = lambda *parts: _u("run", "id", *parts)
_N = lambda *parts: f"(sqrt(-2 * ln(1 - {_D(*parts, chr(39) + 'radius' + chr(39))})) * cos(6.283185307179586 * {_D(*parts, chr(39) + 'angle' + chr(39))}))"
_SWARMED = f"p AS {_SWARM}, b AS (SELECT run, arg_min(x, {{'f': f, 'id': id}}) AS best, list(x ORDER BY id) AS peers, count(*) AS n FROM p GROUP BY 1)"
_TRIED = "list_transform(range(64), lambda j: least(greatest({value}, -5.12), 5.12))"


def _greedy_sql(rows: str, value: str, taken: str = "new_f < f") -> str:
    """``e``: the rows of a step that stay where the new place is not taken."""
    return f"""t AS (SELECT *, {_TRIED.format(value=value)} AS trial FROM {rows}), g AS (SELECT *, list_sum(list_transform(trial, lambda v: v * v)) AS new_f FROM t),
e AS (SELECT run, id, CASE WHEN {taken} THEN trial ELSE x END AS x FROM g)"""


_WHALE = f"""{_SWARMED}, w AS (SELECT run, id, x, best, {_D("'line'")} < 0.5 AS straight, CASE WHEN abs(3 * {_D("'reach'")} - 1.5) >= 1
  THEN peers[floor({_D("'peer'")} * n)::BIGINT + 1] ELSE best END AS goal FROM p JOIN b USING (run))"""
_WHALE_AT = f"""CASE WHEN straight THEN goal[j + 1] - (3 * {_D("j", "0")} - 1.5) * abs(2 * {_D("j", "1")} * goal[j + 1] - x[j + 1])
  ELSE abs(best[j + 1] - x[j + 1]) * exp(2 * (2 * {_D("j", "2")} - 1)) * cos(6.283185307179586 * (2 * {_D("j", "2")} - 1)) + best[j + 1] END"""
_FLAMES = f"""p AS {_SWARM}, q AS (SELECT run, list(x ORDER BY f, id) AS flames, count(*) AS n FROM p GROUP BY 1),
w AS (SELECT run, id, x, flames[least(row_number() OVER (PARTITION BY run ORDER BY id), greatest(1, round_even(n - 0.25 * (n - 1), 0)))::BIGINT] AS goal FROM p JOIN q USING (run))"""
_T = f"(-2.25 * {_D('j')} + 1)"
_FIRES = f"""p AS {_SWARM}, d AS (SELECT a.run, a.id, c.x AS other, exp(-1 / 10.24 ** 2 * list_sum(list_transform(list_zip(c.x, a.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS w
  FROM p a JOIN p c ON a.run = c.run AND (c.f < a.f OR (c.f = a.f AND c.id < a.id))),
s AS (SELECT run, id, sum(w) AS weight, list_transform(range(1, 65), lambda k: list_sum(list_transform(list({{'w': w, 'x': other}}), lambda o: o.w * o.x[k]))) AS total FROM d GROUP BY 1, 2),
w AS (SELECT p.*, weight, total FROM p LEFT JOIN s USING (run, id)), {_greedy_sql("w", f"x[j + 1] + coalesce(least(weight, 1) * (total[j + 1] / weight - x[j + 1]), 0) + 10.24 * ({_D('j')} - 0.5)")}"""
_SIGMA = "power(gamma(2.5) * sin(pi() * 0.75) / (gamma(1.25) * 1.5 * power(2, 0.25)), 1 / 1.5)"
_LEVY = f"({_SIGMA} * {_N('j', chr(39) + 'u' + chr(39))} / power(abs({_N('j', chr(39) + 'v' + chr(39))}), 1 / 1.5))"
_FLOWERS = f"""{_SWARMED}, o AS (SELECT p.*, best, peers, floor({_D("'one'")} * n)::BIGINT AS one, floor({_D("'two'")} * (n - 1))::BIGINT AS two FROM p JOIN b USING (run)),
w AS (SELECT *, {_D("'far'")} < 0.5 AS far, {_D("'part'")} AS part, peers[one + 1] AS a, peers[two + (two >= one)::BIGINT + 1] AS c FROM o),
{_greedy_sql("w", f"CASE WHEN far THEN x[j + 1] + 0.5 * {_LEVY} * (best[j + 1] - x[j + 1]) ELSE x[j + 1] + part * (a[j + 1] - c[j + 1]) END")}"""
_BATS = f"""{_SWARMED}, w AS (SELECT p.*, best, 2 * {_D("'speed'")} AS speed, {_D("'near'")} > 0 AS near FROM p JOIN b USING (run)),
{_greedy_sql("w", f"CASE WHEN near THEN best[j + 1] + 0.05 * 0.75 * 10.24 * {_N('j')} ELSE x[j + 1] + (best[j + 1] - x[j + 1]) * speed END", f"new_f <= f AND {_D(chr(39) + 'taken' + chr(39))} < 1")}"""
_CHAINS = f"p AS {_SWARM}, " + _greedy_sql("p", f"x[j + 1] + 1.024 * {_N('j')}", f"new_f < f OR {_D(chr(39) + 'taken' + chr(39))} < exp(-(new_f - f))")
_ANT = lambda *parts: _u("run", "ant", *parts)
_ARCHIVE = f"""p AS {_SWARM}, k AS (SELECT run, list(x ORDER BY f, id) AS xs, count(*) AS k FROM p GROUP BY 1),
c AS (SELECT *, list_transform(range(k), lambda r: list_sum(list_transform(range(r + 1), lambda q: exp(-power(q / (0.1::DOUBLE * k), 2) / 2)))) AS ends, unnest(range(30)) AS ant FROM k),
g AS (SELECT run, ant, xs, k, xs[least(len(list_filter(ends, lambda e: e <= {_ANT("'guide'")} * ends[-1])) + 1, k)] AS guide FROM c),
m AS (SELECT run, ant, list_transform(range(64), lambda j: least(greatest(guide[j + 1] + greatest(0.85 * list_sum(list_transform(xs, lambda y: abs(y[j + 1] - guide[j + 1]))) / (k - 1), 1e-12)
  * sqrt(-2 * ln(1 - {_ANT("j", "'radius'")})) * cos(6.283185307179586 * {_ANT("j", "'angle'")}), -5.12), 5.12)) AS x FROM g),
a AS (SELECT run, id, 0 AS new, x, f FROM p UNION ALL SELECT run, ant, 1, x, list_sum(list_transform(x, lambda v: v * v)) FROM m),
r AS (SELECT run, x, row_number() OVER (PARTITION BY run ORDER BY f, new, id) AS nth FROM a),
e AS (SELECT n.run, n.id, r.x FROM r JOIN (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY f, id) AS nth FROM p) n ON n.run = r.run AND n.nth = r.nth)"""

for _step, _with, _rows, _value in (
    ("whale", _WHALE, "w", _WHALE_AT),
    ("moth_flame", _FLAMES, "w", f"abs(goal[j + 1] - x[j + 1]) * exp({_T}) * cos(6.283185307179586 * {_T}) + goal[j + 1]"),
    ("firefly", _FIRES, "e", "x[j + 1]"), ("flower", _FLOWERS, "e", "x[j + 1]"), ("bat", _BATS, "e", "x[j + 1]"),
    ("annealing", _CHAINS, "e", "x[j + 1]"), ("ant_archive", _ARCHIVE, "e", "x[j + 1]"),
):
    query(f"WITH {_with} {_moved_sql(_rows, _value)}", f"{_step}_step")(_step_query(_step))


for _step in ("grasshopper", "grey_wolf", "sine_cosine", "differential", "particle_swarm", "gravitation"):

    def _search(spark: SparkSession, sf_dir: str, step=_step) -> DataFrame:
        """From the vectors of the table, until ten iterations or three without a better value."""
        population = _swarm(spark, sf_dir).drop("f")
        return search.search(population, _STEPS[step], objectives.sphere, -5.12, 5.12, budget.Budget(max_iters=10, patience=3))

    query(name=f"search_{_step}")(_search)


@query(f"""WITH p AS {_SWARM}, s AS (SELECT run, j, min(x[j + 1]) AS lo, max(x[j + 1]) AS hi FROM p, (SELECT unnest(range(64)) AS j) GROUP BY 1, 2),
b AS (SELECT run, list(lo ORDER BY j) AS lows, list(hi ORDER BY j) AS highs FROM s GROUP BY 1),
d AS (SELECT run, list_sum(list_transform(range(64), lambda j: (lows[j + 1] + (highs[j + 1] - lows[j + 1]) * {_u("run", "id", "j", iteration=0)}) ** 2)) AS f
  FROM b, (SELECT unnest(range(100)) AS id))
SELECT run, count(*) AS evals, round(min(f), 6) AS best FROM d GROUP BY 1""")
def search_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred points in the box that each run's vectors span."""
    points = search.random_points(search.boxes_of(_swarm(spark, sf_dir)), 100)
    found = points.select("run", objectives.sphere(F.col("x")).alias("f")).groupBy("run").agg(F.count(F.lit(1)).alias("evals"), F.min("f").alias("best"))
    return rounded(found, "best")


_PATIENT = budget.Budget(max_evals=38, max_iters=9, patience=3, min_delta=0.5)


@query("""WITH RECURSIVE e AS (SELECT user_id AS run, value AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth FROM events),
i AS (SELECT run, nth // 5 + 1 AS iter, count(*) AS n, min(f) AS f FROM e WHERE nth < 38 GROUP BY 1, 2),
t AS (SELECT run, 0::BIGINT AS evals, 0::BIGINT AS iters, 'Infinity'::DOUBLE AS best, 'Infinity'::DOUBLE AS mark, 0::BIGINT AS stalled FROM (SELECT DISTINCT run FROM e)
  UNION ALL
  SELECT t.run, t.evals + i.n, t.iters + 1, least(t.best, i.f), CASE WHEN least(t.best, i.f) < t.mark - 0.5 THEN least(t.best, i.f) ELSE t.mark END,
    CASE WHEN least(t.best, i.f) < t.mark - 0.5 THEN 0 ELSE t.stalled + 1 END
  FROM t JOIN i ON i.run = t.run AND i.iter = t.iters + 1 WHERE t.evals < 38 AND t.iters < 9 AND t.stalled < 3)
SELECT run, evals, iters, best, stalled, stalled >= 3 AND evals < 38 AND iters < 9 AS stopped_early FROM t QUALIFY row_number() OVER (PARTITION BY run ORDER BY iters DESC) = 1""")
def patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's events, five to an iteration, would have ended as the evaluations of a search."""
    return budget.replayed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5, _PATIENT)


# Models of undersampled sets, members of ensembles, pheromones --------------------------

_WIDTH = 8
_TRAINING = f"SELECT vec_id AS id, (label = 3)::INTEGER AS y, list_transform(embedding[1:{_WIDTH}], lambda v: floor(v::DOUBLE * 1024)) AS x FROM embeddings"


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, _WIDTH), lambda v: F.floor(v.cast("double") * 1024).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 3).cast("int").alias("y"), x.alias("x"))


@query(f"""WITH r AS ({_TRAINING}), train AS (SELECT * FROM r WHERE id % 3 <> 0), valid AS (SELECT * FROM r WHERE id % 3 = 0),
n AS (SELECT greatest(1, least(count(*) FILTER (y = 1), count(*) FILTER (y = 0))) AS keep FROM train), c AS (SELECT unnest(range(4)) AS cand_id),
kept AS (SELECT cand_id, id FROM (SELECT cand_id, id, row_number() OVER (PARTITION BY cand_id ORDER BY (cand_id + id) % 3 = 0 DESC, md5('7|' || cand_id || '|' || id), id) AS nth
  FROM train, c WHERE y = 0), n WHERE nth <= keep),
sets AS (SELECT cand_id, y, x FROM kept JOIN train USING (id) UNION ALL SELECT cand_id, y, x FROM train, c WHERE y = 1),
flat AS (SELECT cand_id, y, unnest(range({_WIDTH})) AS j, unnest(x) AS v FROM sets),
eps AS (SELECT cand_id, 1e-9 * max(v) AS eps FROM (SELECT cand_id, j, var_pop(v) AS v FROM flat GROUP BY 1, 2) GROUP BY 1),
stats AS (SELECT cand_id, y, j, avg(v) AS mean, var_pop(v) + any_value(eps) AS var FROM flat JOIN eps USING (cand_id) GROUP BY 1, 2, 3),
prior AS (SELECT cand_id, y AS label, ln(count(*) / sum(count(*)) OVER (PARTITION BY cand_id)::DOUBLE) AS prior FROM sets GROUP BY 1, 2),
points AS (SELECT id, y, unnest(range({_WIDTH})) AS j, unnest(x) AS v FROM valid),
scores AS (SELECT s.cand_id, id, s.y AS label, any_value(p.y) AS y, -0.5 * sum(ln(2 * pi() * var) + (v - mean) * (v - mean) / var) AS score FROM points p JOIN stats s USING (j) GROUP BY 1, 2, 3),
picked AS (SELECT cand_id, y, arg_max(label, {{'s': score + prior, 'l': -label}}) AS predicted FROM scores JOIN prior USING (cand_id, label) GROUP BY cand_id, id, y)
SELECT cand_id, round(1 - coalesce(2 * count(*) FILTER (y = 1 AND predicted = 1) / nullif(count(*) FILTER (y = 1) + count(*) FILTER (predicted = 1), 0)::DOUBLE, 0), 6) AS fitness FROM picked GROUP BY 1""")
def undersampling_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four undersampled training sets, each judged by the model fitted on it."""
    rows = _training(spark, sf_dir)
    train = rows.where("id % 3 <> 0")
    bits = train.where("y = 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cand_id"), F.col("id").alias("row_id"))
    bits = bits.withColumn("bit", ((F.col("cand_id") + F.col("row_id")) % 3 == 0).cast("int"))
    return rounded(models.undersampling_fitness(train, rows.where("id % 3 = 0"), bits, seed=_SEED), "fitness")


@query(name="member_probabilities")
def _member_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of ten trees fitted on a third of the vectors; each tree's probability for every vector."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = _training(spark, sf_dir).withColumn("features", array_to_vector("x"))
    forest = RandomForestClassifier(labelCol="y", numTrees=10, maxDepth=3, seed=3).fit(rows.where("id % 3 = 0").repartition(1, "id").sortWithinPartitions("id"))
    return models.member_probabilities(forest, rows).select("id", F.posexplode("p").alias("member", "p")).withColumn("member", F.col("member").cast("long"))


_ANTS = f"""r AS (SELECT DISTINCT vec_id // 32 AS run FROM embeddings),
a AS (SELECT run, id, list_transform(range(16), lambda j: ({_u("run", "id", "j", iteration=0)} < 0.5)::INTEGER::DOUBLE) AS b, floor({_u("run", "id", "'bit'", iteration=0)} * 16) AS one FROM r, (SELECT unnest(range(20)) AS id)),
x AS (SELECT run, id, CASE WHEN list_sum(b) > 0 THEN b ELSE list_transform(range(16), lambda j: (j = one)::INTEGER::DOUBLE) END AS x FROM a),
f AS (SELECT *, list_sum(list_transform(range(16), lambda j: x[j + 1] * ((j * 5) % 7 - 3))) AS f FROM x),
best AS (SELECT run, arg_min(x, {{'f': f, 'id': id}}) AS x, min(f) AS f FROM f GROUP BY 1)"""


@query(f"""WITH {_ANTS} SELECT run, unnest(range(16)) AS pos, unnest(list_transform(x, lambda b: round(0.9 * 0.5 + 0.1 * (1 - b), 6))) AS tau0,
unnest(list_transform(x, lambda b: round(0.9 * 0.5 + 0.1 * b, 6))) AS tau1, f FROM best""")
def ant_colony_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of twenty ants in each run: the pheromones that it leaves and its best value."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: ((j * 5) % 7 - 3).cast("double"))
    objective = lambda x: F.aggregate(F.zip_with(x, weights, lambda b, w: b * w), F.lit(0.0), lambda a, v: a + v)
    pheromones, best = colony.step(colony.fresh(_swarm(spark, sf_dir), 16), None, objective, n=20)
    both = pheromones.join(best.select("run", "f"), "run").select("run", "f", F.posexplode(F.arrays_zip("tau0", "tau1")).alias("pos", "t"))
    return rounded(both.select("run", F.col("pos").cast("long").alias("pos"), F.col("t.tau0").alias("tau0"), F.col("t.tau1").alias("tau1"), "f"), "tau0", "tau1", "f")


# One population of a whole table --------------------------------------------------------


@query(f"""WITH RECURSIVE p AS (SELECT * EXCLUDE (run) FROM {_CUSTOMERS}),
peeled AS (SELECT id, 0 AS front FROM p UNION SELECT q.id, r.front + 1 FROM peeled r JOIN p a ON a.id = r.id
  JOIN p q ON a.f1 <= q.f1 AND a.f2 <= q.f2 AND a.f3 <= q.f3 AND (a.f1 < q.f1 OR a.f2 < q.f2 OR a.f3 < q.f3))
SELECT id, max(front)::BIGINT AS front FROM peeled GROUP BY 1""")
def fronts_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fronts of all customers as one population."""
    return pareto.fronts_of_all(_customers(spark, sf_dir), ["f1", "f2", "f3"], "id")


# Several objectives ---------------------------------------------------------------------

_GENES = 8
_TWO = f"""(SELECT run, id, x, x[1] AS f1, (1 + 9 * list_avg(x[2:])) * (1 - sqrt(x[1] / (1 + 9 * list_avg(x[2:])))) AS f2
  FROM (SELECT vec_id // 32 AS run, vec_id AS id, list_transform(embedding[1:{_GENES}], lambda v: least(abs(v::DOUBLE), 1)) AS x FROM embeddings))"""


def _fronts_sql(rows: str, name: str) -> str:
    """``{name}``: ``rows`` with front and crowding in each run, by two objectives."""
    gaps = ", ".join(f"lead(f{k}) OVER o{k} - lag(f{k}) OVER o{k} AS g{k}, max(f{k}) OVER w - min(f{k}) OVER w AS s{k}" for k in (1, 2))
    orders = ", ".join(f"o{k} AS (PARTITION BY run, front ORDER BY f{k}, id)" for k in (1, 2))
    crowd = " + ".join(f"CASE WHEN g{k} IS NULL THEN 'Infinity'::DOUBLE WHEN s{k} = 0 THEN 0 ELSE g{k} / s{k} END" for k in (1, 2))
    return f"""{name}_peeled AS (SELECT run, id, 0 AS front FROM {rows} UNION SELECT q.run, q.id, r.front + 1 FROM {name}_peeled r JOIN {rows} a ON a.run = r.run AND a.id = r.id
  JOIN {rows} q ON q.run = a.run AND a.f1 <= q.f1 AND a.f2 <= q.f2 AND (a.f1 < q.f1 OR a.f2 < q.f2)),
{name}_numbered AS (SELECT p.*, z.front FROM {rows} p JOIN (SELECT run, id, max(front) AS front FROM {name}_peeled GROUP BY 1, 2) z ON z.run = p.run AND z.id = p.id),
{name} AS (SELECT run, id, x, f1, f2, front, {crowd} AS crowding FROM (SELECT *, {gaps} FROM {name}_numbered WINDOW w AS (PARTITION BY run, front), {orders}))"""


_E = [f"floor({_u('run', 'child // 2', f"'entrant{k}'")} * n)::BIGINT + 1" for k in range(4)]


def _won(a: int) -> str:
    one, two = f"s[{_E[a]}]", f"s[{_E[a + 1]}]"
    return f"CASE WHEN {one}.front < {two}.front OR ({one}.front = {two}.front AND {one}.crowding > {two}.crowding) THEN {one}.x ELSE {two}.x END"


_BLENDED = f"(lo - 0.5 * (hi - lo)) + {_u('run', 'child', 'j', "'blend'")} * ((hi + 0.5 * (hi - lo)) - (lo - 0.5 * (hi - lo)))"
_NORMAL = f"sqrt(-2 * ln(1 - {_u('run', 'child', 'j', "'radius'")})) * cos(6.283185307179586 * {_u('run', 'child', 'j', "'angle'")})"
_GENERATION = f"""pop AS {_TWO}, {_fronts_sql("pop", "rated")},
swarm AS (SELECT run, list({{'id': id, 'front': front, 'crowding': crowding, 'x': x}} ORDER BY id) AS s, count(*) AS n, max(id) AS last FROM rated GROUP BY 1),
parents AS (SELECT run, child, n, last + 1 + child AS id, {_won(0)} AS one, {_won(2)} AS two, {_u("run", "child // 2", "'cross'")} < 0.9 AS crossed FROM (SELECT *, unnest(range(n)) AS child FROM swarm)),
genes AS (SELECT *, unnest(range({_GENES})) AS j FROM parents),
ends AS (SELECT *, least(one[j + 1], two[j + 1]) AS lo, greatest(one[j + 1], two[j + 1]) AS hi FROM genes),
made AS (SELECT run, id, child, j, least(greatest(CASE WHEN crossed THEN {_BLENDED} WHEN child % 2 = 0 THEN one[j + 1] ELSE two[j + 1] END
  + CASE WHEN {_u("run", "child", "j", "'mutate'")} < 1.0::DOUBLE / {_GENES} THEN 0.1 * 0.75 * {_NORMAL} ELSE 0 END, 0), 1) AS v FROM ends),
bred AS (SELECT run, id, list(v ORDER BY j) AS x FROM made GROUP BY 1, 2),
both_ AS (SELECT * FROM pop UNION ALL SELECT run, id, x, x[1], (1 + 9 * list_avg(x[2:])) * (1 - sqrt(x[1] / (1 + 9 * list_avg(x[2:])))) FROM bred),
{_fronts_sql("both_", "merged")}"""


@query(f"""WITH RECURSIVE {_GENERATION}, placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY front, crowding DESC, id) AS place FROM merged)
SELECT run, id, round(f1, 6) + 0.0 AS f1, round(f2, 6) + 0.0 AS f2 FROM placed JOIN swarm USING (run) WHERE place <= n""")
def evolution_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation of populations of 32 vectors with two objectives."""
    x = F.transform(F.slice("embedding", 1, _GENES), lambda v: F.least(F.abs(v.cast("double")), F.lit(1.0)))
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 32).cast("long").alias("run"), F.col("vec_id").alias("id"), x.alias("x"))
    two = lambda x: F.array(objectives.zdt1(x).f1, objectives.zdt1(x).f2)
    found = evolution.generation(rows.withColumn("f", two(F.col("x"))), 2, 1, 0.25, 0.0, 1.0, two)
    return rounded(found.select("run", "id", F.col("f")[0].alias("f1"), F.col("f")[1].alias("f2")), "f1", "f2")


@query(f"""WITH {_SAMPLES}, {_NEAREST}, votes AS (SELECT cand_id, id, fold, y, label, count(*) AS n FROM near GROUP BY ALL),
predicted AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY cand_id, id ORDER BY n DESC, label) = 1),
scores AS (SELECT cand_id, avg(s) AS score FROM (SELECT cand_id, fold, avg((y = label)::INTEGER) AS s FROM predicted GROUP BY 1, 2) GROUP BY 1)
SELECT c.cand_id::BIGINT AS cand_id, round(coalesce(1 - score, 1), 6) + 0.0 AS error, round(len(features) / 64::DOUBLE, 6) AS share FROM c LEFT JOIN scores USING (cand_id)""")
def subset_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest.subset_objectives(_samples(spark, sf_dir), spark.createDataFrame(_SUBSETS, "cand_id long, x array<double>"), _N_FOLDS, _K)
    return rounded(found.select("cand_id", F.col("f")[0].alias("error"), F.col("f")[1].alias("share")), "error", "share")


_PAIRS_OF_RESIDUES = [a + b for a in sequences.RESIDUES for b in sequences.RESIDUES]


@query(f"""WITH p AS (SELECT item_id, {_PROTEIN} AS s FROM benchmark), t AS (SELECT item_id, list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) AS t FROM p WHERE length(s) > 1)
SELECT item_id, unnest({_PAIRS_OF_RESIDUES}) AS pair, round(unnest(list_transform({_PAIRS_OF_RESIDUES}, lambda k: len(list_filter(t, lambda q: q = k)) / len(t)::DOUBLE)), 6) AS share FROM t""")
def dpc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 shares of each sequence that has two residues at least."""
    rows = table(spark, sf_dir, "benchmark").where(F.length(sequences.clean_protein(F.coalesce("text", F.lit("")))) > 1)
    made = sequences.featurized(rows, "text", "dpc").select("item_id", F.posexplode("features").alias("pos", "share"))
    return rounded(made.select("item_id", F.get(F.array(*map(F.lit, _PAIRS_OF_RESIDUES)), F.col("pos")).alias("pair"), "share"), "share")
