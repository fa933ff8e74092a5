"""Every corpus query on the smallest tables, against brute force, a library or DuckDB."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm import fingerprints, license_scan, toxicity
from tessera.llm.common import table
from tessera.llm.queries import ORACLES, QUERIES

from .test_operators import brute_components, brute_print, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}


def answer(spark, name, kinds):
    """The query's rows by their first column; its first columns must be of these types."""
    found = QUERIES[name](spark, SF)
    assert found.dtypes[: len(kinds.split(", "))] == [tuple(k.split(" ")) for k in kinds.split(", ")]
    rows = found.collect()
    out = {r[0]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    theirs, mine = con.execute(ORACLES[name]), QUERIES[name](spark, SF)
    names = sorted(d[0] for d in theirs.description)
    place = [[d[0] for d in theirs.description].index(c) for c in names]
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(mine.columns) == names
    assert sorted((tuple(plain(r[c]) for c in names) for r in mine.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in place) for r in theirs.fetchall()), key=repr)


def test_op1(spark, documents):
    got = answer(spark, "op1_simhash_dedup", "doc_id bigint, fingerprint string, component_id bigint")
    prints = [brute_print(d["text"]) for d in documents.values()]
    want = brute_components(prints, list(documents), 3)
    assert {i: (r[1], r[2]) for i, r in got.items()} == {i: (f"{p:016x}", c) for i, p, c in zip(documents, prints, want, strict=True)}


def test_op2(spark):
    got = answer(spark, "op2_url_filter", "page_id bigint, host string, path string, rule string, verdict string")
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    pages = table(spark, SF, "pages").collect()
    assert set(got) == {p["page_id"] for p in pages}
    for p in pages:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert tuple(got[p["page_id"]])[1:4] == (host, path, rule) and got[p["page_id"]]["verdict"] in ({rules[rule]} if rule else {"allow", "block"})


def test_op4(spark, documents):
    got = answer(spark, "op4_kd_shards", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int")
    assert set(got) == set(documents)
    bytes_of, slots = Counter(), defaultdict(list)
    for i, r in got.items():
        raw = (documents[i]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        bytes_of[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(bytes_of.values()) - min(bytes_of.values()) <= 3 * max(r["size"] for r in got.values())


def test_op5(spark, documents):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    got = answer(spark, "op5_token_counts", "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    known = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for i, d in documents.items():
        n = len(known.encode(d["text"] or "", add_special_tokens=False).ids)
        assert tuple(got[i])[1:] == (len((d["text"] or "").encode()), n, n > 512)


def test_op7(spark, documents):
    got = answer(spark, "op7_license_scan", "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
    for i, d in documents.items():
        w, r = words(d["text"]), got[i]
        at = [(k, v) for p, v in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base = {v for _, v in at}
        assert tuple(r)[1:6] == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted(base)))
        labels = [x for x in r["labels"].split(",") if x]
        assert labels == sorted(set(labels)) and base <= set(labels) and 0 <= r["score"] <= 1


def test_op8(spark):
    got = answer(spark, "op8_language_id", "page_id bigint, language string, probability double, declared string, suffix string, host string")
    assert set(got) == {p["page_id"] for p in table(spark, SF, "pages").collect()}
    assert all(0 <= r["probability"] <= 1 and r["language"] for r in got.values())


def test_op9(spark, documents):
    got = answer(spark, "op9_fingerprints", "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / fingerprints.BITS
    order, of_text = sorted(documents, reverse=True), {}
    for k, i in enumerate(order):
        t, after, r = documents[i]["text"] or "", order[(k + 1) % len(order)], got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + (documents[after]["text"] or "")[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_next"] == like(r["fingerprint"], got[after]["fingerprint"]) and r["near_edited"] == like(r["fingerprint"], r["edited_fingerprint"])
        assert of_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        near = sum((int(r["fingerprint"], 16) ^ int(x["fingerprint"], 16)).bit_count() <= 3 for x in got.values()) - 1
        assert r["n_near"] == near


def test_op10(spark, documents):
    """The scores are those of a classifier trained on all rows that may be learnt, in plain numpy."""
    got = answer(spark, "op10_toxicity", "doc_id bigint, held_out boolean, score double, predicted int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    label, slots = defaultdict(int), toxicity.Slots()
    for r in table(spark, SF, "labels").collect():
        if not held(r["doc_id"]) and r["toxic"] is not None:
            label[r["doc_id"]] = max(label[r["doc_id"]], r["toxic"])
    rows = {i: slots.text(d["text"]) for i, d in documents.items()}
    model = toxicity.train([rows[i] for i, x in label.items() if x and i in rows], [r for i, r in rows.items() if not held(i)], sum(label.values()) / len(label))
    want = dict(zip(rows, model.score(list(rows.values())), strict=True))
    assert set(got) == set(documents)
    for i, r in got.items():
        assert r["held_out"] == held(i) and r["score"] == pytest.approx(want[i], abs=1e-6) and r["predicted"] == int(r["score"] >= 0.7)
