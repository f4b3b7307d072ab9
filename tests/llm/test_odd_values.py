"""What null and empty texts, null ids, repeated rows, clashing columns and empty tables give, operator by operator."""

import hashlib

import pytest

from feedloom.llm import alignment, decontam, filter_audit, licenses, mixing, near_dedup, pii, quality, secret_scan, simhash, substring_dedup, token_count, toxicity

NOTHING = hashlib.sha256(b"").hexdigest()
TEXT = "mail a.b@c.de or 1.2.3.4 and password=hunter22 under the MIT License " * 3
ROWS = [(1, None, "en", "s"), (2, "", None, "s"), (3, " \n\t", "en", None), (None, TEXT, "en", "s"), (5, TEXT, "en", "s"), (5, TEXT, "en", "s"), (6, "é漢😀" * 400, "fr", "t"), (7, "x" * 300_000, "fr", "t")]
#: Operator -> what rows without a word have in common, as (column, value).
RUNS = {
    "pii": (lambda d, s: pii.scan(d), {"n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0, "base_sha256": NOTHING, "spans": ""}),
    "secrets": (lambda d, s: secret_scan.scan(d), {"n_assign": 0, "n_access": 0, "n_hex": 0, "base_sha256": NOTHING, "spans": ""}),
    "quality": (lambda d, s: quality.judge(d, s.createDataFrame([(5, 1), (1, None)], "doc_id long, quality int")), {"n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "base_failed": True, "kept": False}),
    "decontam": (lambda d, s: decontam.scan(d, s.createDataFrame([(1, "hunter22 under the")], "item_id long, text string")), {"n_words": 0, "n_hit": 0, "n_items": 0, "items_sha256": NOTHING, "contaminated": False}),
    "substrings": (lambda d, s: substring_dedup.scan(d), {"n_removed": 0, "n_spans": 0}),
    "toxicity": (lambda d, s: toxicity.scan(d, toxicity.train(d, s.createDataFrame([(5, 1), (6, 0)], "doc_id long, toxic int"))), {"toxic_spans": ""}),
    "tokens": (lambda d, s: token_count.count(d), {}),
    "near": (lambda d, s: near_dedup.classes(d), {}),
    "mixing": (lambda d, s: mixing.taken(d), {"size": 0, "taken": 0}),
    "licenses": (lambda d, s: licenses.scan(d), {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}),
    "simhash": (lambda d, s: simhash.scan(d), {"fingerprint": "0" * 16, "component_id": 1, "n_links": 2}),
    "alignment": (lambda d, s: alignment.scan(d), {}),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    run, empty = RUNS[name]
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clash = plain
    for c in ("row", "score", "spans", "size", "n_words", "class_id", "w", "token", "stratum", "t1", "copy", "s_", "place"):
        clash = clash.withColumn(c, plain["lang"])
    out = run(clash, spark)
    got = out.collect()
    assert sorted(map(repr, got)) == sorted(map(repr, run(plain, spark).collect()))
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(r[0]) for r in ROWS)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert {c: by[i][c] for c in empty} == empty
    fives = [r for r in got if r["doc_id"] == 5]
    if name != "mixing":  # whose blocks are drawn a row
        assert len(fives) == 2 and fives[0] == fives[1]
        assert {c: v for c, v in by[None].asDict().items() if c not in ("doc_id", "class_id")} == {c: v for c, v in fives[0].asDict().items() if c not in ("doc_id", "class_id")}
    nothing = run(clash.limit(0), spark)
    assert nothing.dtypes == out.dtypes and nothing.collect() == []


def test_values(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    rows = lambda name: {r["doc_id"]: r for r in RUNS[name][0](df, spark).collect()}
    r = rows("pii")[5]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (3, 3, 0, 0) and r["spans"].startswith("email:5:13,ip:17:24")
    assert rows("secrets")[5]["n_assign"] == 3 and rows("licenses")[5]["base_labels"] == "mit" and rows("decontam")[5]["n_hit"] == 9
    near = rows("near")
    assert near[5]["class_id"] == 5 and near[None]["class_id"] == 5 and near[1]["class_id"] == 1 and near[7]["class_id"] == 7
    sub = rows("substrings")
    assert sub[1]["kept_sha256"] == NOTHING and sub[3]["n_bytes"] == 3 and sub[7]["n_removed"] == 300_000 and sub[6]["n_spans"] == 1 and sub[5]["n_removed"] == 0
    tox = rows("toxicity")
    assert tox[1]["score"] == tox[2]["score"] == tox[3]["score"] and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in tox.values())
    assert rows("tokens")[1]["n_tokens"] == rows("tokens")[2]["n_tokens"] == 0


def test_contract_columns(spark):
    from feedloom.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    want = {
        "op1_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
        "op2_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        "op3_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op4_decontam": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op5_substring_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
        "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op11_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op13_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
        "op10_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    }
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name, columns in want.items():
        out = Q.QUERIES[name](spark, sf)
        assert ", ".join(f"{c} {t}" for c, t in out.dtypes).startswith(columns), name
        assert out.count() == n
    out = Q.QUERIES["op12_filter_audit"](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    assert out.count() == 600 * spark.read.parquet(f"{sf}/documents.parquet").selectExpr("coalesce(lang, '') AS part").distinct().count()


def test_audit_of_odd_rows(spark):
    """Long and null texts and ids, in two parts and one without a name."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    out = filter_audit.scan(df, spark.createDataFrame([(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    last = {r["part"]: r for r in out.where("filter_order = 'EABCD' AND step = 1").collect()}
    assert {p: r["kept"] + r["removed"] for p, r in last.items()} == {"": 1, "en": 5, "fr": 2}
    assert (last["en"]["removed"], last[""]["removed"], last["en"]["good_lost"]) == (0, 1, 0)
