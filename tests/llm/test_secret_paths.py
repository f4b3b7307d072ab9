"""Long keys and signed tokens are found; paths and addresses are not."""

import base64
import json
import hashlib
import random
import re
import string

from feedloom.llm import secret_scan

ENC = secret_scan.encoding(open(secret_scan.VOCABULARY, "rb").read())


def added(text):
    return [text[a:b] for a, k, b in secret_scan.all_spans(text, ENC)[1] if k == 3]


def test_keys_with_slashes_and_signed_tokens():
    r = random.Random(5)
    keys = [base64.b64encode(r.randbytes(192)).decode() for _ in range(100)]
    assert sum(k.count("/") >= 3 for k in keys) > 50
    assert [added(f"see {k} here") for k in keys] == [[k] for k in keys]
    parts = [base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', json.dumps({"sub": "8471620935", "name": "a5f0c2"}).encode(), r.randbytes(32))]
    assert added(f"use {'.'.join(parts)} now") == parts


def test_paths_and_addresses():
    for t in (
        "in /usr/local/lib/python3.13/site-packages/pyspark/sql/functions2",
        "in /var/lib/x/Zx81kPq0Vw7LmT4nBv92QsXe",
        "src/main/java/org/apache/spark/sql/catalyst/Expr4Test12",
        "at a8/b9/c10/d11/e12/f13/g14/h15",
        "at https://cdn.x.org/1f0a9c8b7e6d5a4/app7Kq2ZpX9vLm3Rt8Wd/main3.js",
        "user.name2023.example12.internal34host.com",
    ):
        assert added(t) == [], t


def test_random_strings_of_one_case():
    r = random.Random(11)
    for letters in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.digits + string.ascii_lowercase, string.hexdigits.upper()):
        keys = ["".join(r.choices(letters, k=40)) for _ in range(50)]
        assert sum(added(f"key {k} end") == [k] for k in keys) >= 48, letters


def test_words_identifiers_and_rules_are_left():
    for t in (
        "internationalization straightforwardness misunderstandings",
        "get_user_account_by_identifier getUserAccountByIdentifier CONFIGURATION_MANAGEMENT_OPTIONS INTERNATIONALIZATION",
        "-" * 60 + " " + "=" * 80 + " " + "_" * 33 + " " + "x" * 5000 + " " + "ha" * 300,
        "Donaudampfschifffahrtsgesellschaft Geschwindigkeitsbegrenzung anticonstitutionnellement",
    ):
        assert added(t) == [], added(t)


def plain(text):
    """The contract's patterns."""
    forms = [r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+"]
    long = (lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(forms) for m in re.finditer(p, text) if long[k](m))


def test_query_equals_plain_patterns(spark):
    from feedloom.llm.queries import op2_secrets

    sf = "/root/testdata/sf0.001"
    got = op2_secrets(spark, sf)
    assert got.dtypes[:6] == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    rows = {r["doc_id"]: r for r in got.collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base, r = plain(d["text"] or ""), rows[d["doc_id"]]
        names = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(names.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in base) for k in range(3)]
        assert {*names.split(",")} - {""} <= {*r["spans"].split(",")}


def test_base_of_odd_texts():
    r = random.Random(4)
    bits = ["password", "PassWd", "api_key", "apikey", "token", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef00", "f" * 30, "é", "abcdef", ".", "-", "xyz", "\n", "/+", "AKIAAKIA" * 3]
    for _ in range(400):
        t = "".join(r.choice(bits) for _ in range(30))
        base, every = secret_scan.all_spans(t, ENC)
        assert base == plain(t) and set(base) <= set(every)
        assert all(b <= x or y <= a for a, k, b in every if k == 3 for x, _, y in base)
