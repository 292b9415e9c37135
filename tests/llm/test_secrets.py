import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from evidentia.llm import common, secrets
from evidentia.llm.queries import op9_secrets

# The detectors as stated, with failing matches dropped.
PLAIN = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def brute(text):
    out = [(m.start(), k, m.end(), kind) for k, (kind, (p, test)) in enumerate(PLAIN.items()) for m in re.finditer(p, text, re.A) if test(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def texts():
    rng = random.Random(6)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "passwd", "=", ":", " ", '"', "'", "abc", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "😀", "\n", "x.y/z+", "-", "ſecret", "toKen="]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("found", F.lit("clash")).withColumn("row", F.lit(1))


def test_query(spark, write_tables):
    ghp = "ghp_" + "a1B2" * 9
    live, copied = f"key {ghp}0 end", f"key {ghp}9 end"
    rows = [(i, t, f"s{i % 7}") for i, t in enumerate([*texts(), None, "", "a" * 50_000, "token=" * 2000, live])]
    rows += [(1000 + i, copied, f"s{i}") for i in range(5)] + [(2000, copied, None), (None, "AKIA" + "Z" * 20, "s1"), (5, rows[5][1], "s5")]
    folder = write_tables(documents=table(spark, rows))
    got = op9_secrets(spark, folder).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, r)
    for doc_id, text, _ in rows:
        want, r = brute(text or ""), by_id[doc_id]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in PLAIN)
        if text not in (live, copied):
            assert r.spans == want
    assert by_id[rows[404][0]].spans == "other:4:45" and by_id[1000].spans == ""
    assert by_id[None].n_live == 1


def test_frequencies_count_distinct_owners(spark):
    rows = [(1, "AKIA" + "B" * 16, "a"), (2, "AKIA" + "B" * 16, "a"), (3, "AKIA" + "B" * 16, "b"), (3, "AKIA" + "B" * 16, "b")]
    got = secrets.scan(table(spark, rows)).collect()
    assert {(x.repositories, x.owners, x.live) for r in got for x in r.found} == {(3, 2, True)}


def test_what_very_many_repositories_hold_is_copied(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 3)
    rows = [(i, "token = " + ("a1b2c3d4e5f6g7" if i < 105 else f"z9y8x7w6v5u4{i}"), "one") for i in range(120)]
    got = {r.doc_id: r.found[0] for r in secrets.scan(table(spark, rows)).collect()}
    assert all((x.repositories, x.owners, x.live) == ((105, 1, False) if i < 105 else (1, 1, True)) for i, x in got.items())


def test_very_many_matches(spark):
    text = "token=abcdefghijkl " * 20_000 + "ghp_" + "a1B2" * 9 + " key ghp_" + "a1B2" * 9
    r = secrets.scan(table(spark, [(1, text, "s")])).first()
    assert len(r.found) == 20_002 and [(x.start, x.end) for x in r.found[19_999:]] == [(19 * 19_999, 19 * 19_999 + 18), (380_000, 380_040), (380_045, 380_085)]


def test_oracle(spark, write_tables):
    rows = [(i, t, f"s{i % 7}") for i, t in enumerate(texts())]
    folder = write_tables(documents=table(spark, rows))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    cols = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied", "most_repositories", "most_owners"]
    want = sorted(con.execute(f"select {', '.join(cols)} from ({secrets.ORACLE})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in op9_secrets(spark, folder).collect()) == want


def test_empty_table(spark):
    assert secrets.scan(table(spark, [])).count() == 0
