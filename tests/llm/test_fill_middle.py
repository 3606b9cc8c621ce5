import hashlib
import os
import re

from compare import check_engine, compare
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.odd import DOCS

from civiclake.llm import fill_middle as M
from civiclake.llm import queries

ALPHABET = st.sampled_from("aBz é\n<>PSM😀1")


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60), st.integers(0, 60), st.integers(0, 60), st.sampled_from([M.PSM, M.SPM, M.PLAIN]))
def test_parts_are_exchanged_and_come_back(text, a, b, form):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = ("".join(units[i:j]).encode() for i, j in ((0, low), (low, high), (high, None)))
    out = bytes(M.transform(p + m + s, len(p), len(p + m), form))
    expected = {M.PLAIN: p + m + s, M.PSM: b"<P>" + p + b"<S>" + s + b"<M>" + m, M.SPM: b"<S>" + s + b"<P>" + p + b"<M>" + m}
    assert out == expected[form]
    if form == M.PLAIN or not any(x in text.encode() for x in M.SENTINELS):
        assert M.restored(out, form) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=50), st.integers(0, 50), st.integers(0, 50), st.integers(1, 5))
def test_reversal_by_any_buffer(data, a, b, buffer):
    a, b = sorted((a % (len(data) + 1), b % (len(data) + 1)))
    held = bytearray(data)
    with memoryview(held) as block:
        M.reverse(block, a, b, buffer)
    assert bytes(held) == data[:a] + data[a:b][::-1] + data[b:]


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or h[2] % 100 >= 90 or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_odd_rows(spark, odd, none):
    extra = spark.createDataFrame([(200 + i, t, *[None] * 8) for i, t in enumerate(["a<P>b", "<S>", "x <M", "<", "P>", "\0é", "zz<M>" * 9])], DOCS)
    docs = odd.unionByName(extra)
    done = M.restore(M.fill_in_middle(docs)).collect()
    assert sorted((tuple(r)[:6] for r in done), key=repr) == sorted((by_hand(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert sorted(((r["_id"], r["_restored"]) for r in done), key=repr) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=repr)
    assert {r["_form"] for r in done} == {"plain", "psm", "spm"}
    assert M.restore(M.fill_in_middle(none)).count() == 0


def test_query_equals_its_sql(spark):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    assert compare(spark, check_engine(sf), queries.QUERIES["op13_fill_middle"], queries.ORACLES["op13_fill_middle"], sf) is None
