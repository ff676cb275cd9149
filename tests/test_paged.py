"""The paged source against a service on this machine; tables kept as a whole or not at all."""

from __future__ import annotations

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from evoframe.operators import activities
from evoframe.sources import store
from evoframe.sources.paged import PagedSource, get_json


@pytest.fixture
def service():
    """A service with 2,345 records that sends 400 at most, refuses every third request once, and fails for one target."""
    asked, refused, lock = [], Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            query = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            key = (query.get("offset"), query.get("limit"))
            with lock:
                asked.append(query)
                refused[key] += 1
                busy = len(asked) % 3 == 0 and refused[key] < 3
            if query.get("target_chembl_id") == "bad" or busy:
                self.send_response(404 if not busy else 429)
                self.end_headers()
                return
            total = 0 if query.get("target_chembl_id") == "none" else 2345
            start, count = int(query.get("offset", 0)), min(int(query.get("limit", 20)), 400)
            rows = [{"molecule_chembl_id": f"M{i % 1000}", "canonical_smiles": None if i % 10 == 0 else f"C{i % 1000}", "standard_relation": "=" if i % 4 else ">",
                     "standard_units": "nM", "pchembl_value": None if i % 7 == 0 else str(4 + i % 50 / 10), "n": i} for i in range(start, min(start + count, total))]
            raw = json.dumps({"activities": rows, "page_meta": {"total_count": total}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/activity.json", asked
    server.shutdown()


def read(spark, url: str, schema: str = "n long, pchembl_value double, molecule_chembl_id string", **options):
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").schema(schema).options(url=url, records="activities", backoff=0.01, pause=0, **options).load()


def test_all_pages_are_read_once(spark, service):
    url, asked = service
    found = read(spark, url, page=500, only="fields")
    assert found.rdd.getNumPartitions() == 5
    rows = found.collect()
    assert sorted(r.n for r in rows) == list(range(2345))
    assert {r.n: (r.pchembl_value, r.molecule_chembl_id) for r in rows} == {i: (None if i % 7 == 0 else 4 + i % 50 / 10, f"M{i % 1000}") for i in range(2345)}
    assert {q["fields"] for q in asked} == {"n,pchembl_value,molecule_chembl_id"}
    assert {int(q["offset"]) for q in asked} == {0, 400, 500, 900, 1000, 1400, 1500, 1900, 2000}  # the last page is short


def test_limits_and_refusals(spark, service):
    url, _ = service
    assert sorted(r.n for r in read(spark, url, page=300, most=700).collect()) == list(range(700))
    assert read(spark, url, query="target_chembl_id=none").count() == 0
    with pytest.raises(Exception, match="1 of 4 tries"):
        get_json(f"{url}?target_chembl_id=bad", backoff=0.01)
    with pytest.raises(Exception, match="2 of 2 tries"):
        get_json("http://127.0.0.1:9/none", tries=2, backoff=0.01)
    with pytest.raises(Exception, match="schema of the columns"):
        spark.read.format("paged_json").options(url=url).load()


def test_fetched_once_and_cleaned_in_counted_steps(spark, service, tmp_path):
    url, asked = service
    records = activities.fetched(spark, url, "T1", folder=str(tmp_path), backoff=0.01, pause=0)
    n = len(asked)
    table, funnel = activities.target_table(activities.fetched(spark, url, "T1", folder=str(tmp_path)))
    rows = [i for i in range(2345) if i % 10 and i % 4 and i % 7]
    steps = {r.step: r.n for r in funnel.collect()}
    assert steps == {"records fetched": 2345, "with SMILES": 2345 - 235, "relation '='": sum(1 for i in range(2345) if i % 10 and i % 4),
                     "units 'nM'": sum(1 for i in range(2345) if i % 10 and i % 4), "with pChEMBL": len(rows), "unique molecules": len({i % 1000 for i in rows})}
    assert len(asked) == n and records.count() == 2345
    assert {r.molecule_chembl_id: r.n_measurements for r in table.collect()} == Counter(f"M{i % 1000}" for i in rows)
    assert activities.report(funnel).splitlines()[0] == "records fetched  : 2345" and activities.report(funnel).count("\n") == 5
    with pytest.raises(ValueError, match="survived filtering"):
        activities.target_table(records, organism="Mus musculus")
    with pytest.raises(ValueError, match="no IC50 records of none"):
        activities.fetched(spark, url, "none", folder=str(tmp_path), backoff=0.01)
    assert activities.status(url)["page_meta"]["total_count"] == 2345


def test_every_measurement_and_censored_records(spark):
    rows = [("A", "CCO", "=", "nM", 7.0, "Homo sapiens"), ("A", "CCO", "=", "nM", 7.4, "Homo sapiens"), ("B", "CCN", "=", "nM", 5.5, "Homo sapiens"), ("C", "CCC", ">", "nM", 6.1, "Homo sapiens"),
            ("D", "CCF", "=", "uM", 6.2, "Homo sapiens"), ("E", None, "=", "nM", 8.0, "Homo sapiens"), ("F", "CCBr", "=", "nM", None, "Homo sapiens"), ("G", "CCCl", "=", "nM", 6.9, "Rattus norvegicus")]
    names = "molecule_chembl_id string, canonical_smiles string, standard_relation string, standard_units string, pchembl_value double, target_organism string"
    records = spark.createDataFrame(rows, names)
    table, funnel = activities.target_table(records)
    assert [r.n for r in funnel.orderBy("step_no").collect()] == [8, 7, 6, 5, 4, 3]
    assert {r.molecule_chembl_id: round(r.pchembl, 9) for r in table.collect()} == {"A": 7.2, "B": 5.5, "G": 6.9}
    assert activities.target_table(records, how=None)[0].count() == 4
    assert {r.step: r.n for r in activities.target_table(records, relation=None)[1].collect()}["units 'nM'"] == 6
    assert {r.step: r.n for r in activities.target_table(records, organism="Homo sapiens")[1].collect()}["organism 'Homo sapiens'"] == 4


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_a_table_is_kept_whole_or_not_at_all(spark, tmp_path, kind):
    folder = str(tmp_path / "kept" / kind)
    rows = spark.createDataFrame([(i, f"a {i}", i / 4) for i in range(50)], "n int, s string, v double").repartition(4)
    failing = rows.withColumn("s", F.when(F.col("n") == 41, F.raise_error(F.lit("lost"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="lost"):
        store.kept(spark, folder, lambda: failing, kind)
    assert not (tmp_path / "kept").exists() or not any((tmp_path / "kept").iterdir())
    with pytest.raises(ValueError):
        store.resolve(spark, None, folder)
    with pytest.raises(ValueError):
        store.resolve(spark, str(tmp_path / "nothing"), folder)
    first = store.kept(spark, folder, lambda: rows, kind)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, rows.collect())) and first.dtypes == rows.dtypes
    again = store.kept(spark, folder, lambda: pytest.fail("made again"), kind)
    assert again.count() == 50
    with pytest.raises(Exception, match="lost"):
        store.kept(spark, folder, lambda: failing, kind, refresh=True)
    assert store.kept(spark, folder, lambda: failing, kind).count() == 50
    assert store.kept(spark, folder, lambda: rows.limit(3), kind, refresh=True).count() == 3
    assert store.resolve(spark, None, folder) == folder and store.resolve(spark, folder, "x") == folder
    assert [p.name for p in (tmp_path / "kept").iterdir() if not p.name.endswith(".crc")] == [kind]
