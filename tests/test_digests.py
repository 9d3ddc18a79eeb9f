"""Canonical digests over random nested schemas, classes of conflicts, tenants in batches, phrases, codes and window streams, against plain Python."""

import hashlib
import json
import math
import random
from datetime import datetime, timedelta
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import distribution as X
from weftline.operators import ledger as L
from weftline.operators import search as V
from weftline.operators.changes import Refused

TEXTS = ["", "a", 'q"b\\', "\n\t\x01", "é\u20ac", "\U0001f600", "z" * 30]


def kind(r, depth):
    """A random type without floats."""
    flat = [T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DecimalType(12, 3), T.BinaryType(), T.DateType()]
    if depth == 0 or r.random() < 0.4:
        return r.choice(flat)
    if r.random() < 0.3:
        return T.ArrayType(kind(r, depth - 1))
    if r.random() < 0.3:
        return T.MapType(T.StringType(), kind(r, depth - 1))
    names = r.sample(["b", "a", "é", "Z", "a b", "\uffee", "x1"], r.randrange(1, 4))
    return T.StructType([T.StructField(n, kind(r, depth - 1)) for n in names])


def value(r, t):
    if r.random() < 0.15:
        return None
    if isinstance(t, T.StructType):
        return {f.name: value(r, f.dataType) for f in t.fields}
    if isinstance(t, T.ArrayType):
        return [value(r, t.elementType) for _ in range(r.randrange(3))]
    if isinstance(t, T.MapType):
        return {k: value(r, t.valueType) for k in r.sample(TEXTS[1:], r.randrange(4))}
    if isinstance(t, T.DecimalType):
        return Decimal(r.randrange(-10**6, 10**6)).scaleb(-r.choice([0, 1, 3]))
    return {"string": lambda: r.choice(TEXTS), "bigint": lambda: r.choice([0, -5, (1 << 53) - 1, 1 << 53, -(1 << 62)]), "int": lambda: r.randrange(-9, 9), "boolean": lambda: r.random() < 0.5, "binary": lambda: bytes([r.randrange(256) for _ in range(3)]), "date": lambda: datetime(2024, 1, 1).date() + timedelta(days=r.randrange(900))}[t.simpleString()]()


def text(v, t):
    """The canonical JSON of a value, another way."""
    order = lambda k: k.encode("utf-16-be")
    quoted = lambda s: json.dumps(s, ensure_ascii=False)
    if v is None:
        return "null"
    if isinstance(t, T.StructType):
        kinds = {f.name: f.dataType for f in t.fields}
        return "{" + ",".join(f"{quoted(k)}:{text(v[k], kinds[k])}" for k in sorted(kinds, key=order)) + "}"
    if isinstance(t, T.ArrayType):
        return "[" + ",".join(text(x, t.elementType) for x in v) + "]"
    if isinstance(t, T.MapType):
        return "{" + ",".join(f"{quoted(k)}:{text(v[k], t.valueType)}" for k in sorted(v, key=order)) + "}"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v) if abs(v) < 1 << 53 else quoted(str(v))
    if isinstance(v, Decimal):
        plain = format(v.normalize(), "f")
        return plain if "." not in plain else quoted(plain)
    return quoted(v.hex() if isinstance(v, (bytes, bytearray)) else str(v))


def shuffled(r, t):
    """The same type with the fields of all structs in another order."""
    if isinstance(t, T.StructType):
        fields = [T.StructField(f.name, shuffled(r, f.dataType)) for f in t.fields]
        return T.StructType(r.sample(fields, len(fields)))
    if isinstance(t, T.ArrayType):
        return T.ArrayType(shuffled(r, t.elementType))
    return T.MapType(t.keyType, shuffled(r, t.valueType)) if isinstance(t, T.MapType) else t


def as_row(v, t):
    if v is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(as_row(v[f.name], f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [as_row(x, t.elementType) for x in v]
    return dict(reversed([(k, as_row(x, t.valueType)) for k, x in v.items()])) if isinstance(t, T.MapType) else v


@pytest.mark.parametrize("seed", range(8))
def test_digests_of_random_schemas(spark, seed):
    r = random.Random(seed)
    schema = T.StructType([T.StructField(f"c{k}", kind(r, 3)) for k in range(3)])
    data = [{f.name: value(r, f.dataType) for f in schema.fields} for _ in range(12)]
    found = []
    for s in (schema, shuffled(r, schema)):
        df = spark.createDataFrame([as_row(v, s) for v in r.sample(data, len(data))], s)
        assert sorted(x["d"] for x in df.select(L.row_digest(df).alias("d")).collect()) == sorted(hashlib.sha256(text(v, schema).encode()).hexdigest() for v in data)
        found.append(tuple(L.content_digest(df).first()))
    assert found[0] == found[1] and found[0][0] == 12
    digests = [hashlib.sha256(text(v, schema).encode()).hexdigest() for v in data]
    sums = ":".join(str(sum(int(d[15 * k : 15 * k + 15], 16) for d in digests)) for k in range(4))
    assert found[0][1] == hashlib.sha256(f"12:{sums}".encode()).hexdigest()


def test_digest_refuses_floats(spark):
    for kind_ in ("double", "array<float>", "struct<a:double>", "map<string,double>"):
        with pytest.raises(Refused):
            L.content_digest(spark.createDataFrame([], f"x {kind_}"))
    empty = L.content_digest(spark.createDataFrame([], "x int")).first()
    assert tuple(empty) == (0, hashlib.sha256(b"0:0:0:0:0").hexdigest())


def test_decimals_have_one_form(spark):
    df = spark.createDataFrame([(Decimal("5.000"), Decimal(5)), (Decimal("-0.100"), None), (Decimal("12345678901234567.5"), Decimal("12345678901234567890"))], "a decimal(38,3), b decimal(20,0)")
    got = [x["t"] for x in df.select(F.concat_ws(" ", L.canonical(F.col("a"), df.schema["a"].dataType), L.canonical(F.col("b"), df.schema["b"].dataType)).alias("t")).collect()]
    assert got == ["5 5", '"-0.1" null', '"12345678901234567.5" "12345678901234567890"']


def test_conflict_classes_count_the_pairs(spark):
    r = random.Random(3)
    specs = [(k, r.choice("ab"), r.randrange(2), r.sample(["x", "y", "z", "w"], r.choice([0, 1, 2, 2]))) for k in range(60)]
    df = spark.createDataFrame(specs, "spec_id long, database string, level int, relations array<string>")
    pairs = L.conflict_pairs(df).collect()
    at = {k: (db, level) for k, db, level, _ in specs}
    got = L.conflict_classes(df).collect()
    links = {(x["database"], x["level"], x["relation"]): x["links"] for x in got}
    want = {}
    for p in pairs:
        for relation in p["shared"] or [None]:
            want[*at[p["a"]], relation] = want.get((*at[p["a"]], relation), 0) + 1
    assert links == want and len(got) <= sum(max(1, len(s[3])) for s in specs)
    asked = spark.createDataFrame([(k,) for k in range(0, 60, 7)], "spec_id long")
    some = {(p["a"], p["b"], tuple(p["shared"])) for p in L.conflicts_of(df, asked).collect()}
    assert some == {(p["a"], p["b"], tuple(p["shared"])) for p in pairs if p["a"] % 7 == 0 or p["b"] % 7 == 0} and some


def test_a_tenant_of_many_batches(spark):
    """State goes from batch to batch of a tenant, also of NULL, and no batch is larger than asked."""
    df = spark.range(5000).select((F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "b")).alias("g"), F.col("id").alias("k"))

    def step(state, batch):
        count, calls = state or (0, 0)
        return (count + batch.num_rows, calls + 1), {"g": batch.column("g"), "k": batch.column("k"), "place": [count + i for i in range(batch.num_rows)], "calls": [calls + 1] * batch.num_rows}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = X.per_tenant_batches(df, "g", ["k"], step, "g string, k long, place long, calls long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in ("hot", "b", None):
        mine = sorted((x["k"], x["place"]) for x in got if x["g"] == g)
        assert [p for _, p in mine] == list(range(len(mine))) and len(mine) == {"hot": 4500, "b": 250, None: 250}[g]
    assert max(x["calls"] for x in got if x["g"] == "hot") >= 45


def test_phrases_and_nearness(spark):
    r = random.Random(5)
    docs = [(k, [r.choice("abc") for _ in range(r.randrange(30))]) for k in range(40)]
    words = spark.createDataFrame([(k, p, w) for k, ws in docs for p, w in enumerate(ws)], "id int, position int, lexeme string")
    index = V.inverted_index(words)
    for phrase in (["a", "b"], ["a", "a", "b"], ["c", "a", "c", "b"], ["b"], ["a", "missing"]):
        want = {k: s for k, ws in docs if (s := [p for p in range(len(ws)) if ws[p : p + len(phrase)] == phrase])}
        assert {x["id"]: x["starts"] for x in V.text_phrase(index, phrase).collect()} == want
    counts = {w: sum(w in ws for _, ws in docs) for w in "abc"}
    rare, *rest = sorted("abc", key=lambda w: (counts[w], w))
    want = {k: s for k, ws in docs if (s := [p for p, w in enumerate(ws) if w == rare and all(any(ws[q] == x and abs(p - q) <= 1 for q in range(len(ws))) for x in rest)])}
    assert {x["id"]: x["at"] for x in V.text_near(index, ["a", "b", "c"], 1).collect()} == want and want
    with pytest.raises(Refused):
        V.text_phrase(index, [])


def test_half_precision_has_its_range(spark):
    import numpy as np

    values = [0.0, -0.0, 1.0, 1 / 3, 65504.0, 65519.9, 65520.0, 70000.0, -1e9, 1e-9, 2.0**-25, 2.0**-24, 3.1e-8, 6e-5, 6.1e-5, 1e-7, math.inf, -math.inf, math.nan]
    got = spark.createDataFrame([([*values, None],)], "v array<double>").select(V.half(F.col("v"))).first()[0]
    with np.errstate(over="ignore"):
        want = np.array(values).astype(np.float16).astype(float)
    assert np.array_equal(np.array(got[:-1]), want, equal_nan=True) and got[-1] is None
    vectors = spark.createDataFrame([(1, [1.0, 65519.0]), (2, [1.0, -65520.0])], "id int, v array<float>")
    assert [(x["id"], x["problem"]) for x in V.check_dims(vectors, "v", 2, "halfvec").collect()] == [(2, "out_of_range")]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_codes_estimate_products(spark, bits):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((200, 24))
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(200, [0.0] * 24)], "id long, v array<float>")
    rows = V.code_vectors(df, bits).collect()
    assert {len(r["code"]) for r in rows} == {24 * bits // 8}
    turn, q = V.rotation(24, 1), np.random.default_rng(2).standard_normal((50, 24))
    assert np.allclose(turn @ turn.T, np.eye(24))
    error = []
    for r in rows[:200]:
        raw = np.frombuffer(r["code"], np.uint8)
        if bits < 8:
            raw = (np.unpackbits(raw, bitorder="little").reshape(24, bits) << np.arange(bits, dtype=np.uint8)).sum(1)
        error.append(q @ turn @ V._levels(raw, bits) * r["factor"] - q @ x[r["id"]])
    assert np.std(error) < {1: 4.0, 2: 3.0, 4: 0.8, 8: 0.05}[bits] and abs(np.mean(error)) < 0.1


def test_index_searches_what_it_says(spark, tmp_path):
    """With all lists probed the neighbours are exact, also in blocks and from two levels of centroids; unread lists are pruned."""
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 8)) * 5
    x = centres[r.integers(40, size=3000)] + r.standard_normal((3000, 8)) * 0.3
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "id long, v array<float>")
    queries = df.filter("id % 100 = 0").withColumnsRenamed({"id": "q_id", "v": "q"})
    exact = {(a["q_id"], a["id"]) for a in V.knn(queries, df, 5).collect()}
    for name, lists in (("one", None), ("two", 300)):
        index = V.ivf_write(df, f"{tmp_path}/{name}", lists)
        assert index.table().count() == 3000 and len(index.centres) > 40
        assert {(a["q_id"], a["id"]) for a in V.ivf_search(queries, index, 5, len(index.centres)).collect()} == exact
        probes = V.ivf_probes(index, queries, 5)
        found = V.ivf_search(queries, index, 5, probes)
        assert len({(a["q_id"], a["id"]) for a in found.collect()} & exact) >= 0.9 * len(exact)
        near = V._nearest_centres(np.array([a["q"] for a in queries.orderBy("q_id").collect()]), index.centres, probes)
        sizes = {a["list"]: a["count"] for a in index.table().groupBy("list").count().collect()}
        assert np.mean([sum(sizes.get(c, 0) for c in row) for row in near]) < 0.12 * 3000
    one = queries.limit(1)
    plan = V._search_lists(index, one, [0], np.array([one.first()["q"]], float), 5, 1)
    assert "PartitionFilters: [list#" in plan._jdf.queryExecution().executedPlan().toString().replace("isnotnull(list", "list")


def test_profile_of_maps(spark):
    from weftline.operators.profile import profile

    df = spark.createDataFrame([({"b": 1, "a": 2}, [{"x": 1}]), ({"a": 2, "b": 1}, None), (None, [{"x": 1}])], "m map<string,int>, l array<map<string,int>>")
    got = {r["column"]: tuple(r)[1:] for r in profile(df).collect()}
    assert got == {"m": (3, 1, 1, '{"a":2,"b":1}', '{"a":2,"b":1}'), "l": (3, 1, 1, '[{"x":1}]', '[{"x":1}]')}
    assert {r["column"] for r in profile(df, approximate=True).collect()} == {"m", "l"}
