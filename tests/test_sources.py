"""The API's own filters, two-phase files and the cache of answers."""

import csv
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from taxolens.operators import cache
from taxolens.sources import api, writer

WORKS = [{"id": f"W{i}", "type": ("article", "book", None)[i % 3], "publication_year": 2015 + i % 6, "cited_by_count": i, "language": "en", "primary_topic": {"id": f"T{i % 2}"} if i % 5 else None} for i in range(60)]


@pytest.fixture(scope="module")
def served():
    """An API of WORKS that knows equality, lists, null, ``>`` and ``<``, and what it was asked."""
    asked = []

    def fits(work, said):
        name, _, value = said.partition(":")
        have = (work["primary_topic"] or {}).get("id") if name == "primary_topic.id" else work[name]
        if value in ("null", "!null"):
            return (have is None) == (value == "null")
        if value[0] in "<>":
            return have is not None and (have > int(value[1:]) if value[0] == ">" else have < int(value[1:]))
        return have is not None and str(have) in value.split("|")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append(query.get("filter"))
            rows = [w for w in WORKS if all(fits(w, f) for f in (query.get("filter") or "").split(",") if f)]
            at = 0 if query["cursor"] == "*" else int(query["cursor"])
            body = {"meta": {"count": len(rows), "next_cursor": str(at + 7) if at + 7 < len(rows) else None}, "results": rows[at : at + 7]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


@pytest.mark.parametrize(("where", "sent"), [
    ("type = 'book'", "type:book"),
    ("publication_year >= 2018 and cited_by_count < 40", "cited_by_count:<40,publication_year:>2017"),
    ("publication_year in (2015, 2020) and topic_id = 'T1'", "primary_topic.id:T1,publication_year:2015|2020"),
    ("type is null", "type:null"),
    ("type <> 'book'", None), ("length(id) = 2", None), ("type = 'a b, c'", None), ("type = 'book' or cited_by_count = 3", None), ("type = 'book' and id like '%7'", "type:book"),
])
def test_filters_go_into_requests(spark, served, where, sent):
    url, asked = served
    asked.clear()
    local = spark.createDataFrame([(w["id"], w["type"], w["publication_year"], w["cited_by_count"], w["language"], (w["primary_topic"] or {}).get("id")) for w in WORKS], "id string, type string, publication_year int, cited_by_count long, language string, topic_id string")
    got = {r.id for r in api.works(spark, url).where(where).collect()}
    assert got == {r.id for r in local.where(where).collect()}
    said = {",".join(sorted(x for x in (a or "").split(",") if x and not x.endswith(":!null"))) for a in asked}
    assert said == {sent or ""}


def test_ranges_are_parts(spark, served):
    url, asked = served
    asked.clear()
    rows = api.works(spark, url, by="publication_year", **{"from": "2014", "to": "2020"}, filter="language:en").where("type = 'book'")
    assert rows.rdd.getNumPartitions() == 7 and {r.id for r in rows.collect()} == {w["id"] for w in WORKS if w["type"] == "book"}
    assert {a for a in asked} >= {f"language:en,type:book,publication_year:{y}" for y in range(2014, 2021)} or all("type:book" in a and "publication_year:" in a for a in asked)
    with pytest.raises(Exception, match="parts go by"):
        api.works(spark, url, by="language").collect()


def test_groups_are_read_by_tasks(spark):
    calls = spark.sparkContext.accumulator(0)

    def get(url):
        calls.add(1)
        return {"group_by": [{"key": "a", "key_display_name": "A", "count": 3}]}

    rows = api.grouped(spark, "http://x", "f", "k", get)
    assert calls.value == 0 and [tuple(r) for r in rows.collect()] == [("a", "A", 3)]


def test_files_in_two_phases(spark, tmp_path):
    rows = spark.range(1000).select((999 - F.col("id")).alias("n"), F.concat(F.lit('a"b,é\n'), "id").alias("t")).repartition(7).orderBy("n")
    path = tmp_path / "out.csv"
    path.write_text("old")

    def broken(batch):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        with writer.Staged(tmp_path) as stage:
            stage.parts(writer.mapped(rows, lambda r: broken(r) if r["n"] == 990 else "x\n"), "rows")
    assert path.read_text() == "old" and list(tmp_path.iterdir()) == [path]
    writer.write_csv(path, rows)
    with open(path, newline="") as f:
        found = list(csv.reader(f))
    assert found[0] == ["n", "t"] and found[1:] == [[str(n), f'a"b,é\n{999 - n}'] for n in range(1000)] and list(tmp_path.iterdir()) == [path]
    writer.write_csv(path, rows.limit(0))
    assert path.read_bytes() == b"n,t\r\n"
    with writer.Staged(tmp_path) as stage:
        spread = rows.repartitionByRange(5, "n").sortWithinPartitions("n")
        parts = stage.parts(spread.select(F.concat(F.col("n").cast("string"), F.lit("\n"))), "p")
        stage.joined(parts, "ordered")
        assert (stage.folder / "ordered").read_text() == "".join(f"{n}\n" for n in range(1000))
        assert sum(p["rows"] for p in parts) == 1000 and len(parts) > 1
        open(parts[0]["path"], "a").write("more")
        with pytest.raises(writer.WriteError):
            stage.joined(parts, "whole")


def test_cache_of_answers(spark, tmp_path, monkeypatch):
    held = cache.Cache(spark, str(tmp_path / "c"), "key string, logit double, v array<double>", 4)
    assert held.answers().isEmpty() and held.version() == 0
    answers = spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("double").alias("logit"), F.array(F.lit(1.0)).alias("v"))
    held.add(answers)
    held.add(answers)  # run again
    assert held.stored().count() == 200 and held.answers().count() == 100 and len(held.files()) == 8
    asked = spark.range(90, 110).select(F.concat(F.lit("k"), "id").alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = held.missing(asked)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # what is asked, not the cache
        assert {r.key for r in held.missing(asked).collect()} == {f"k{i}" for i in range(100, 110)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = held.stored()
    held.compact()
    assert held.version() == 2 and len(held.files()) == 4 and held.stored().count() == 100
    assert before.count() == 200  # a reader that began before
    again = cache.Cache(spark, str(tmp_path / "c"), "key string, logit double, v array<double>", 64)
    assert again.buckets == 4 and {r.key: r.logit for r in again.found(asked).collect()} == {f"k{i}": float(i) for i in range(90, 100)}
    monkeypatch.setattr(cache, "MOST_FILES", 1)
    again.add(answers.limit(1))
    assert again.version() == 3 and again.answers().count() == 100
    (tmp_path / "c" / "stray.parquet").write_text("")
    with pytest.raises(cache.CacheError):
        cache.Cache(spark, str(tmp_path / "c"), "key string, logit double, v array<double>")


@pytest.fixture(scope="module")
def world():
    """A whole API: topics by cursor, seeded samples of works page by page, group-bys."""
    up = lambda level, n: {"id": f"https://openalex.org/{level}s/{n}", "display_name": f"{level} {n}"}
    topics = [{"id": f"https://openalex.org/T{i}", "display_name": f"topic {i}", "description": None, "keywords": [f"k{i}", "all"], "subfield": up("subfield", 1), "field": up("field", 1), "domain": up("domain", 1), "works_count": 10_000 if i in (3, 7) else 10, "cited_by_count": i, "created_date": "2024", "updated_date": "2025", "siblings": [{"id": "x"}] * i} for i in range(1, 10)]
    work = lambda n, t: {"id": f"https://openalex.org/W{n}", "doi": None, "title": f"title {n}", "type": "article", "primary_location": {"source": {"id": f"S{n % 4}", "display_name": "src"}}, "primary_topic": {"id": f"https://openalex.org/T{t}"} if n % 10 else None, "topics": [{"id": f"https://openalex.org/T{t}"}]}
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            parsed = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(parsed.query).items()}
            asked.append((parsed.path, q))
            if parsed.path == "/topics":
                at = 0 if q["cursor"] == "*" else int(q["cursor"])
                body = {"meta": {"count": len(topics), "next_cursor": str(at + 4) if at + 4 < len(topics) else None}, "results": topics[at : at + 4]}
            elif "group_by" in q:
                body = {"group_by": [{"key": "2020", "key_display_name": "2020", "count": 7}] if q["group_by"] == "publication_year" else [{"key": "https://openalex.org/S1", "key_display_name": "one", "count": 1500}]}
            else:
                topic = int(q["filter"].rpartition("T")[2]) if "T" in q["filter"] else 1
                first = 1000 * topic + (int(q["page"]) - 1) * int(q["per-page"])
                body = {"results": [work(n, topic) for n in range(first, min(first + int(q["per-page"]), 1000 * topic + int(q["sample"])))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_pull(spark, world, tmp_path, capsys):
    from taxolens import cli
    from taxolens.sources import readers

    url, asked = world
    assert cli.main(["pull", "--api", url, "--output-dir", str(tmp_path)]) == 0
    doc = json.loads((tmp_path / "topics.json").read_text())
    assert doc["topic_count"] == 9 and [t["id"][-1] for t in doc["topics"]] == [str(i) for i in range(1, 10)] and doc["topics"][4]["sibling_count"] == 5
    table = list(csv.DictReader((tmp_path / "topics.csv").open()))
    assert [r["topic_id"] for r in table][:3] == ["T3", "T7", "T1"] and table[0]["keyword_count"] == "2" and list(table[0])[-2:] == ["created_date", "updated_date"]
    assert (tmp_path / "unassigned_by_year.csv").read_text().splitlines()[1:] == ["2020,7,7"]
    assert len((tmp_path / "unassigned_by_source_type.csv").read_text().splitlines()) == 6
    asked.clear()
    assert cli.main(["pull", "--api", url, "--output-dir", str(tmp_path), "--works", "both", "--topics", str(tmp_path / "topics.json"), "--sample-size", "250"]) == 0
    assert sum(p == "/works" for p, _ in asked) == 6  # two pages for the labelled works and for each large topic
    sha = readers.read_snapshot(spark, str(tmp_path / "topics.json")).sha256
    place = json.loads((tmp_path / "place-dataset.json").read_text())
    assert place["exclusions"]["missing_primary_topic"] == 25 and place["sampling"] == {"requested": 250, "returned": 250} and sum(place["partition_counts"].values()) == 225 == len(place["records"])
    assert readers.read_place(spark, str(tmp_path / "place-dataset.json"), sha).rows.count() == 225
    sinks = json.loads((tmp_path / "sink-samples.json").read_text())
    assert [(s["topic_id"], s["sampling"]) for s in sinks["sinks"]] == [(t, {"requested": 250, "returned": 250}) for t in ("T3", "T7")] and sinks["median_topic_works"] == 10
    assert readers.read_sinks(spark, str(tmp_path / "sink-samples.json"), sha).rows.count() == 500
    before = (tmp_path / "topics.json").read_bytes()
    assert cli.main(["pull", "--api", url + "/none", "--output-dir", str(tmp_path), "--topics-only"]) != 0
    assert (tmp_path / "topics.json").read_bytes() == before and {p.name for p in tmp_path.iterdir()} == {"topics.json", "topics.csv", "unassigned_by_year.csv", "unassigned_by_source_type.csv", "place-dataset.json", "sink-samples.json"}
    capsys.readouterr()
