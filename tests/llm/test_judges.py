"""Quality, language, URL, personal-data and top-k operators, and the pipeline."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
import regex

import corpus_pipeline
from evoframe.llm import language, pii, quality, queries, topk, urlfilter


def brute_base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(again), failed


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_base_rules(spark, request, table):
    docs = request.getfixturevalue(table)
    docs = spark.read.parquet(f"{docs}/documents.parquet") if isinstance(docs, str) else docs
    labels = spark.createDataFrame([(4, 1), (8, 1), (None, 1), (12, 1)], "doc_id long, quality int")
    texts = Counter((r.doc_id, *brute_base(r.text)) for r in docs.select("doc_id", "text").collect())
    found = quality.judge_quality(docs, labels).collect()
    assert Counter((r.doc_id, *[r[c] for c in quality.BASE], r.base_failed) for r in found) == texts
    assert all(not r.kept for r in found if r.base_failed)


def test_scores_are_mean_log_ratios(spark):
    good, bad = "alpha beta gamma delta " * 20, "### $$$ %%% &&& " * 20
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    total, trusted = Counter(), Counter()
    fits = {r.good_id for r in quality.trusted_ids(labels).where("fit").collect()}
    for i in range(40):
        at = quality.ngram_buckets(quality.read_words(good if i % 2 else bad)[1])
        total.update(at.tolist())
        if i in fits:
            trusted.update(at.tolist())
    n, t = sum(total.values()), sum(trusted.values())
    for i in (0, 1):
        at = quality.ngram_buckets(quality.read_words(good if i % 2 else bad)[1]).tolist()
        q = {b: (total[b] + 1) / (n + (1 << quality.BITS)) for b in at}
        ratio = [np.log((trusted[b] + quality.PRIOR * t * q[b]) / (t + quality.PRIOR * t) / q[b]) for b in at]
        assert found[i].score == pytest.approx(np.mean(ratio))
    assert found[1].score > found[1].threshold > found[0].score


def test_no_trusted_document(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = quality.judge_quality(awkward, labels).collect()
    assert all(r.kept != r.base_failed for r in found)
    assert quality.judge_quality(nothing, labels).count() == 0
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in found)


def longest_match_phrases(word: str, words: list[str]) -> int:
    text, marked, n = f"{language._START}{word}{language._END}", [f"{language._START}{w}{language._END}" for w in words], 0
    while text:
        k = max([k for k in range(1, len(text) + 1) if any(text[:k] in w for w in marked)], default=1)
        text, n = text[k:], n + 1
    return n


def test_automaton_parses_by_longest_matches():
    words = ["banana", "ananas", "bandana", "nab", "a", "banana", "ban"]
    made = language.SuffixAutomaton(words)
    for word in ("banana", "nana", "xyz", "anax", "bandananas", "b", "", "aaaa"):
        assert made.phrases(word) == longest_match_phrases(word, words), word


def test_language_of_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language.identify(docs).collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.held_out]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_awkward_documents(awkward, nothing):
    found = language.identify(awkward).collect()
    assert len(found) == awkward.count()
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2)} == {"und"}
    assert language.identify(nothing).count() == 0


def test_signs_are_no_letters_and_ties_go_to_the_first(spark):
    rows = [(i, text, lang) for i, (text, lang) in enumerate([("gleich gleich", "b"), ("gleich gleich", "a")] * 9)]
    rows += [(100, "½ ² ①", "a"), (101, "gleich", None), (102, "", None)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (found[100].lang_pred, found[100].score) == ("und", 0.0) and found[102].lang_pred == "und"
    assert (found[101].lang_pred, found[101].score) == ("a", 0.0)


def test_every_trusted_document_counts(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word and w"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("quality"))
    assert quality.trusted_ids(labels).count() == 45_000
    fit, held = (quality.trusted_texts(docs, labels, side) for side in (True, False))
    assert fit.count() + held.count() == 45_000 and fit.join(held, "text").count() == 0 and 20_000 < fit.count() < 25_000
    assert quality.bucket_counts(fit).agg(F.sum("n")).first()[0] == 5 * fit.count()


def test_url_terms():
    assert urlfilter.term_hits("http://a.example/porn/x") == (1, 0)
    assert urlfilter.term_hits("http://a.example/pornography") == (0, 0)
    assert urlfilter.term_hits("http://Sex.example/adult-SEX_casino") == (0, 3)
    assert urlfilter.term_hits("http://sussex.example/adults") == (0, 0)


def test_urls(spark, nothing):
    urls = [
        None, "", "no scheme/porn", "http://EXAMPLE.com/en/7?x", "https://a.b.net/de/9", "http://x.example.net/de/81", "http://notexample.com/en/1",
        "http://example.org/es/#q", "http://u@h.example/casino/poker", "http://h.example/casino", "://h/p?q", "http://net", "http://h\n.example/a\nb", "http://a/xxx",
    ]
    pages = spark.createDataFrame([(i if i else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    pages.toPandas()
    found = urlfilter.judge_urls(pages)
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    want = Counter(con.sql(urlfilter.oracle()).fetchall())
    assert Counter(tuple(r) for r in found.collect()) == want
    by_url = {i: v for i, _, _, _, v, *_ in want}
    assert [by_url[i] for i in (3, 4, 5, 7, 8, 9)] == ["allow", "block", "block", "block", "block", "allow"]


def test_rules_are_those_of_the_contract(spark):
    assert urlfilter.RULES == (
        ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
    )
    urls = ["https://a.b.net/de/9", "https://a.b.net/de/xxx", "http://x.example.net/de/81", "http://example.net/de/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages).collect()}
    assert found == {0: ("net/de/", "allow"), 1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow")}
    want = duckdb.connect()
    want.register("pages", pages.toPandas())
    assert {(i, rule, v) for i, _, _, rule, v, *_ in want.sql(urlfilter.oracle(urlfilter.RULES)).fetchall()} == {(i, *r) for i, r in found.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_surrogates(spark, awkward):
    found = {r.doc_id: r for r in pii.pii_digest(awkward).collect() if r.doc_id is not None}
    text = found[14].text
    assert found[14].n_entities == 7
    for gone in ("bob.smith", "corp.example", "555-7713", "4929348385146306", "10.2.3.4"):
        assert gone not in text
    match = re.fullmatch(
        r"Mail [a-z]{3}\.[a-z]{5}@mail\d+\.example\.org or \+1 \(\d{3}\) \d{3}-\d{4}, card (\d{16}), (2[45]\d(?:\.\d{1,3}){3}) twice (\S+), Mrs (\w+) and Mr (\w+)\.", text
    )
    assert match, text
    assert luhn(match[1]) and match[2] == match[3]
    assert all(found[i].text == r.text for i, r in {r.doc_id: r for r in awkward.collect() if r.doc_id not in (None, 14)}.items())


def test_surrogates_stay_distinct_and_names_match(spark):
    values = [(f"{a}.{b}.0.{c}", "address") for a in range(3) for b in range(20) for c in range(20)] + [(str(i).zfill(3) + "-00-0000", "security") for i in range(300)]
    table = pii.surrogates(spark.createDataFrame(values, "value string, kind string")).collect()
    new = [r.surrogate for r in table]
    assert len(set(new)) == len(values) and not set(new) & {v for v, _ in values}
    docs = spark.createDataFrame([(1, "Frau Müller, Herr Müller, Г-жа Иванова, Dr. Anna Schmidt, MR SMITH"), (2, "Frau Müller")], "doc_id long, text string")
    one, two = (r.text for r in pii.replace_pii(docs).orderBy("doc_id").collect())
    assert "Müller" not in one and "Иванова" not in one and "Schmidt" not in one
    assert one.startswith(two) and re.search(r"Г-жа [А-Яа-яё]+,", one) and re.search(r"Dr\. \w+ \w+", one)


def test_names_corefer_and_clashing_columns_stay(spark):
    text = "Mr Smith met Mr. SMITH and Mr John Smith, Dr. Παπαδόπουλος paid DE89 3704 0044 0532 0130 00."
    docs = spark.createDataFrame([(1, text, "a", "b"), (2, None, "c", "d")], "doc_id long, text string, found string, row string")
    one, two = pii.replace_pii(docs).orderBy("doc_id").collect()
    match = re.fullmatch(r"Mr (\w+) met Mr\. (\w+) and Mr (\w+) (\w+), Dr\. ([Α-ώΆ-Ώ]+) paid (DE[0-9 ]+)\.", one.text)
    assert match, one.text
    assert match[1] != "Smith" and match[1].upper() == match[2] and match[4] == match[1] and match[3] != "John" and match[5] != "Παπαδόπουλος"
    number = match[6].replace(" ", "")
    assert len(number) == 22 and int(number[4:] + "1314" + number[2:4]) % 97 == 1 and number != "DE89370400440532013000"
    assert (one.found, one.row, two.text, two.found, two.row) == ("a", "b", None, "c", "d")


def test_surrogates_collide_in_a_tight_space(spark, monkeypatch):
    values = spark.createDataFrame([(f"+1 {i:03d} 00", "phone") for i in range(60)], "value string, kind string")
    monkeypatch.setattr(pii, "_rewritten", lambda value, digest: __import__("pyspark").sql.functions.concat(
        __import__("pyspark").sql.functions.lit(" "), __import__("pyspark").sql.functions.substr(digest, *map(__import__("pyspark").sql.functions.lit, (1, 2)))))
    found = [r.surrogate for r in pii.surrogates(values).collect()]
    assert len(set(found)) == 60


def brute_entities(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and kind: at each place every kind is tried in turn."""
    kinds, found, at = {k: regex.compile(p) for k, p in pii.KINDS.items()}, [], 0
    while at < len(text):
        kind, match = next(((k, m) for k, p in kinds.items() if (m := p.match(text, at))), (None, None))
        if match:
            found.append((at, match.end(), kind))
        at = match.end() if match else at + 1
    return found


def test_personal_data_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "x@y.org x@Y.ORG z@y.org v1.2.3.4 SSN123-45-6789 +49 30 1234567 and 030-555-1234, Mr Bo Li; Mr Li"), (-2, "")], docs.schema))
    new = {r.doc_id: (r.text, r.n_entities) for r in pii.pii_digest(docs).collect()}
    old = {r.doc_id: r.text or "" for r in docs.collect()}
    spans = {i: brute_entities(text) for i, text in old.items()}
    values = {(old[i][a:b], kind) for i, found in spans.items() for a, b, kind in found}
    table = {r.value: r.surrogate for r in pii.replacements(spark.createDataFrame(sorted(values), "value string, kind string")).collect()}
    assert set(table) == {v for v, _ in values} and len(values) > 20 and not set(table.values()) & set(table)
    for i, text in old.items():
        cuts = [0, *(e for a, b, _ in spans[i] for e in (a, b)), len(text)]
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        assert new[i] == ("".join(table[p] if k % 2 else p for k, p in enumerate(pieces)), len(spans[i])), i
    kinds = {k: regex.compile(p) for k, p in pii.KINDS.items()}
    for value, kind in values:
        assert kinds[kind].fullmatch(table[value]), (value, table[value])
    assert table["x@y.org"].split("@")[1] == table["x@Y.ORG"].split("@")[1] == table["z@y.org"].split("@")[1]


def test_very_long_entities(spark):
    n = 100_000
    texts = ["a@" + "b." * n + "com", "a" * n + "@corp.example.com", "a@" + "b" * n + ".com", "4" * n, "1-" * n, "10." * n, "DE12 " + "A1B2 " * n,
             "sk-" + "a" * n, "f1" * n, "Mr " + "A" + "b" * n, "+1 " + "23 " * n, "(017) " + "555-" * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in pii.replace_pii(docs).collect()}
    assert len(found) == len(texts) and found[1].endswith(".example.org") and found[2] != texts[2]
    assert found[0] == texts[0]  # no domain has so many labels


def test_no_personal_data(nothing):
    assert pii.pii_digest(nothing).count() == 0


def brute_top(rows: list[tuple], k: int, every: int) -> set:
    whole = [(i, [int(np.floor(1024 * float(np.float32(v)))) for v in x]) for i, x in rows]
    out = set()
    for q, x in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q and len(x) == len(y))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("bucket", [16, 4096])
def test_top_k(spark, bucket):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(12, 8)) * np.array([[3.0], [0.1]] * 6)
    sound = [(i, (centres[i % 12] + 0.05 * draw.normal(size=8)).astype(np.float32).tolist()) for i in range(240)]
    sound += [(1000 + i, [0.5] * 8) for i in range(30)] + [(2000, [0.0] * 8), (3000, [1.0, 2.0]), (3001, [1.0, -2.0])]
    unsound = [(400, None), (None, [1.0] * 8), (500, [float("nan")] * 8), (600, [float("inf")] + [0.0] * 7), (700, [None] * 8), (800, [])]
    frame = spark.createDataFrame([(i, x, 1) for i, x in sound + unsound], "vec_id long, embedding array<float>, dim int")
    found = {tuple(r) for r in topk.top_k(frame, every=20, bucket=bucket, query_block=5).collect()}
    assert found == brute_top(sound, 10, 20)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, small)
    names = sorted(want.columns)
    assert sorted(found.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    rows = con.sql(f"SELECT {quoted} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(rows) == Counter(tuple(r) for r in found.select(*names).collect())


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, small)
        if number == len(corpus_pipeline.STAGES) - 1:
            break
        assert after.columns == columns, name
        assert after.count() <= before.count()
        before = spark.createDataFrame(after.collect(), docs.schema)
    kept = {r.doc_id for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == kept
    assert 0 < len(kept) < docs.count()
    assert not any("@mail" in r.text and ".example.com" in r.text for r in before.collect())
