import http.server
import json
import struct
import threading
import time
import urllib.error
import urllib.parse

import pytest
from pyspark.sql import functions as F

from rillflow.operators import aggregates as A
from rillflow.operators import reshape, spatial
from rillflow.sources import layers, paged


def test_budget(spark):
    df = spark.range(10)
    assert layers.within_budget(df, 10).count() == 10
    with pytest.raises(layers.LayerTooLarge) as e:
        layers.within_budget(df, 9)
    assert e.value.limit == 9


def test_bbox_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS fid", "id * 1.0D AS xmin", "id + 1.0D AS xmax", "0.0D AS ymin", "1.0D AS ymax", "'x' AS heavy").write.parquet(str(tmp_path / "l"))
    got = layers.scan(spark.read.parquet(str(tmp_path / "l")), (10, 0, 12, 1), columns=["fid"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "heavy" not in plan and "LessThanOrEqual(xmin" in plan and {r.fid for r in got.collect()} == {9, 10, 11, 12}


def test_raw_grids(spark, tmp_path):
    (tmp_path / "g.bil").write_bytes(struct.pack("<6f", *range(6)))
    got = layers.raw_grids(spark, str(tmp_path / "g.bil"), 3, 2).collect()
    assert [(r.r, r.c, r.z) for r in got] == [(k // 3, k % 3, float(k)) for k in range(6)]
    with pytest.raises(Exception, match="bytes where"):
        layers.raw_grids(spark, str(tmp_path / "g.bil"), 3, 3).collect()


def test_json_features(spark, tmp_path):
    doc = {"features": [{"properties": {"a": "x"}, "geometry": {"type": "LineString", "coordinates": [[1, 2.5], [-3, 1e1]]}}, {"properties": {"a": None}, "geometry": None}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    got = layers.json_features(spark, str(tmp_path / "f.json"), "a:string").collect()
    assert (got[0].a, got[0].kind, got[0].xmin, got[0].ymin, got[0].xmax, got[0].ymax) == ("x", "LineString", -3.0, 2.5, 1.0, 10.0)
    assert got[1].kind is None and got[1].xmin is None


class Service(http.server.BaseHTTPRequestHandler):
    """23 points k, k with a name, a length and a long text; page 4 fails once, page 8 comes spoilt until asked under another URL."""

    calls: list = []
    sent: list = []
    told = True
    busy = most = 0
    lock = threading.Lock()

    def do_GET(self):
        with Service.lock:
            Service.busy += 1
            Service.most = max(Service.most, Service.busy)
        try:
            self.answer({k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()})
        finally:
            with Service.lock:
                Service.busy -= 1

    def answer(self, q):
        Service.calls.append(q)
        here = range(23)
        if "bbox" in q:
            x0, y0, x1, y1 = map(float, q["bbox"].split(","))
            here = [k for k in here if max(x0, y0) <= k <= min(x1, y1)]
        if "resourceid" in q:
            here = [k for k in here if f"f{k}" in q["resourceid"].split(",")]
        if q.get("resulttype") == "hits":
            return self.reply(f'<c numberMatched="{len(here) if Service.told else "unknown"}" numberReturned="0"/>'.encode())
        start = int(q.get("startindex", 0))
        time.sleep(0.02)
        if start == 4 and sum(c.get("startindex") == "4" for c in Service.calls) == 1:
            return self.send_error(503)
        if start == 8 and "_again" not in q:
            return self.reply(b"<html>busy")
        if start == 12 and q["typenames"] == "hollow":
            return self.reply(b"")
        here = here[start : start + int(q.get("count", 100))]
        wanted = q["propertyname"].split(",") if "propertyname" in q else ["name", "length", "heavy", "geom"]
        each = [{"name": f"n{k}", "length": k / 2 if k % 5 else "?", "heavy": "x" * 1000} for k in here]
        body = [{"id": f"f{k}", "properties": {n: v for n, v in e.items() if n in wanted}, "geometry": {"type": "Point", "coordinates": [k, k]} if "geom" in wanted else None} for k, e in zip(here, each)]
        self.reply(json.dumps({"features": body}).encode())

    def reply(self, body):
        Service.sent.append(len(body))
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def service(monkeypatch):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    Service.calls, Service.sent, Service.told, Service.most = [], [], True, 0
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/wfs"
    server.shutdown()


def pages_asked():
    return [c for c in Service.calls if "resulttype" not in c]


def test_paged_source(spark, service):
    rows = paged.read(spark, service, "l", page_size=4, parallel=2).collect()
    assert sorted((r.ord, r.fid, json.loads(r.properties)["name"], r.xmin, r.coordinates) for r in rows) == [(k, f"f{k}", f"n{k}", float(k), f"[{k}, {k}]") for k in range(23)]
    # six pages, one tried again after an error, one under another URL; never more than two at once
    assert len(Service.calls) - len(pages_asked()) == 1 and len(pages_asked()) == 8 and Service.most <= 2
    assert [c["_again"] for c in pages_asked() if "_again" in c] == ["1"]


def test_paged_columns_travel_alone(spark, service):
    df = paged.read(spark, service, "l", "name string, length double, none long", page_size=10)
    got = sorted(tuple(r) for r in df.select("name", "length", "none", "ymax").collect())
    assert got == sorted((f"n{k}", k / 2 if k % 5 else None, None, float(k)) for k in range(23))
    assert {c["propertyname"] for c in pages_asked()} == {"name,length,none,geom"} and sum(Service.sent) < 5000
    Service.calls.clear()
    bare = spark.read.format("pages").schema("name string").options(url=service, layer="l", page_size=30).load()
    assert bare.count() == 23 and {c["propertyname"] for c in pages_asked()} == {"name"}


def test_paged_boxes_and_ids(spark, service):
    df = paged.read(spark, service, "l", "name string", page_size=2, parallel=3)
    box = layers.scan(df, (14, 13, 18.5, 30))
    assert sorted(r.name for r in box.collect()) == [f"n{k}" for k in range(14, 19)]
    assert {c["bbox"] for c in Service.calls} == {"14.0,13.0,18.5,30.0"} and len(pages_asked()) == 4  # three pages, one asked for twice
    Service.calls.clear()
    assert sorted(r.name for r in df.where("fid IN ('f3', 'f20', 'zz') AND xmin > 5").collect()) == ["n20"]
    assert [c.get("resourceid") for c in Service.calls] == ["f20,f3,zz"]
    Service.calls.clear()
    assert df.where("fid = 'f1' AND fid = 'f2'").count() == 0 and not pages_asked()
    half = df.where("xmin <= 3")
    assert half.count() == 4 and all("bbox" not in c for c in Service.calls)
    # a box in an option stays as it is: what meets both boxes need not meet where they overlap
    Service.calls.clear()
    given = paged.read(spark, service, "l", "name string", bbox="12,12,21,21")
    assert layers.scan(given, (0, 0, 16, 16)).count() == 5 and {c["bbox"] for c in Service.calls} == {"12,12,21,21"}


def test_paged_budget_and_unknown_number(spark, service):
    with pytest.raises(Exception, match="more than 22"):
        paged.read(spark, service, "l", limit=22).count()
    assert not pages_asked()
    assert paged.read(spark, service, "l", limit=23).count() == 23
    Service.told = False
    assert paged.read(spark, service, "l", page_size=6).count() == 23
    with pytest.raises(Exception, match="more than 22"):
        paged.read(spark, service, "l", page_size=6, limit=22).collect()
    assert layers.scan(paged.read(spark, service, "l", page_size=6), (90, 90, 99, 99)).count() == 0


def test_paged_empty_replies(spark, service):
    assert paged.read(spark, service, "hollow", page_size=12, empty="true").count() == 12
    with pytest.raises(OSError, match="empty"):
        paged.fetch(f"{service}?typenames=hollow&startindex=12", delay=0, tries=2)


class Records(http.server.BaseHTTPRequestHandler):
    calls: list = []

    def do_GET(self):
        q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
        codes, page = q["code"][0].split(","), int(q.get("page", ["1"])[0])
        Records.calls.append((len(codes), page))
        here = codes[(page - 1) * 60 : page * 60]
        after = f"http://{self.headers['Host']}{self.path}&page={page + 1}" if page == 1 and len(codes) > 60 else None
        data = [{"code": c, "n": k} for c in here for k in range(int(c) % 2 + 1)] if codes != ["9999"] else None
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"data": data, "next": after}).encode())

    def log_message(self, *args):
        pass


def test_records_in_lists_of_codes(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Records)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/r"
    codes = spark.createDataFrame([(str(k),) for k in range(230)] + [("",), (None,), ("7",)], "c string")
    try:
        got = [json.loads(r.record) for r in paged.records(codes.coalesce(1), "c", url, "code", size=60).collect()]
        none = paged.records(spark.createDataFrame([("9999",)], "c string"), "c", url, "code").count()
    finally:
        server.shutdown()
    assert sorted((r["code"], r["n"]) for r in got) == sorted((str(k), n) for k in range(230) for n in range(k % 2 + 1))
    assert none == 0 and max(n for n, _ in Records.calls) <= 100 and any(page == 2 for _, page in Records.calls)


def test_client_errors_are_not_tried_again(service):
    with pytest.raises((urllib.error.HTTPError, OSError)):
        paged.fetch(service.replace("/wfs", "") + "/?startindex=x", delay=0, tries=1)


def test_reshape(spark):
    fields = [("id", "STRING", "Identifiant"), ("area_ha", "DOUBLE", "Surface (ha)"), ("n", "INT", "Nombre")]
    df = reshape.fitted(spark.createDataFrame([("a", 1, 2)], "id string, area_ha int, other int"), reshape.schema(fields))
    assert df.dtypes == [("id", "string"), ("area_ha", "double"), ("n", "int")]
    rows = reshape.indicators(df, "id", {"area_ha": "Sol", "n": "Sol"}).collect()
    assert [tuple(r) for r in rows] == [("a", "Sol", "area_ha", "Surface", "ha", 1.0, None)]
    assert reshape.faults([("a", "INT", ""), ("a", "X", "b")]) != []


def test_tie_rules(spark):
    df = spark.createDataFrame([("k", 2020, 2, "b"), ("k", 2020, 1, "a"), ("k", None, 0, "x"), (None, 2021, 0, "y")], "k string, y int, ord int, v string")
    assert [r.v for r in A.latest(df, ["k"], "y", "ord").collect()] == ["a"]
    shares = spark.createDataFrame([("a", 60.0), ("b", 0.5), ("c", 0.4), ("d", 39.1)], "l string, p double")
    assert {r.l: round(r.p, 6) for r in A.chart_groups(shares, "l", "p").collect()} == {"a": 60.0, "d": 39.1, "Autres": 0.9}
    assert A.chart_groups(spark.createDataFrame([("a", 99.99), ("b", 0.01)], "l string, p double"), "l", "p").count() == 1


def test_pairs_meet_once(spark):
    import random

    rng = random.Random(1)
    rows = lambda n, size: [(k, x, y, x + rng.uniform(0, size), y + rng.uniform(0, size)) for k in range(n) for x, y in [(rng.uniform(-30, 30), rng.uniform(-30, 30))]]
    a, b = rows(60, 12), rows(40, 25)
    cols = "id long, xmin double, ymin double, xmax double, ymax double"
    for size, margin in ((5.0, 0.0), (17.0, 3.0)):
        got = sorted((r.id, r.r_id) for r in spatial.pairs(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), size, margin).collect())
        want = sorted((p[0], q[0]) for p in a for q in b if p[1] - margin <= q[3] and q[1] <= p[3] + margin and p[2] - margin <= q[4] and q[2] <= p[4] + margin)
        assert got == want


def test_unused_union_keys(spark):
    df = layers.union_layers({"a": spark.range(1), "b": spark.range(2).withColumn("x", F.lit(1))})
    assert df.count() == 3 and df.columns == ["id", "layer", "x"]
