import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymill.llm import tokens

RANKS = tokens.vocabulary()


def slow(text, sections):
    encoding, _ = tokens.encoder(RANKS)
    counts, crossing, outside = [0] * len(sections), 0, 0
    raw, at = text.encode(), 0
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    for token in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(token))
        chars = set(char_of[at : at + n])
        at += n
        shares = [len(chars & set(range(a, b))) for _, a, b in sections]
        if not any(shares):
            outside += 1
            continue
        counts[shares.index(max(shares))] += 1
        crossing += max(shares) < len(chars)
    assert at == len(raw)
    return counts, crossing, outside


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\n.,é日🙂'1", max_size=60), st.lists(st.integers(0, 60), max_size=6))
def test_matches_brute_force(text, cuts):
    cuts = sorted({min(c, len(text)) for c in cuts})
    for sections in (tokens.lines(text), tokens.bare_lines(text), [(str(i), a, b) for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]):
        counts, crossing, outside = tokens.attribute(*tokens.token_spans(text, RANKS), sections)
        assert (counts.tolist(), crossing, outside) == slow(text, sections)


def test_overlaps_and_order():
    start, end = np.array([0, 2, 4]), np.array([2, 4, 6])
    assert tokens.attribute(start, end, [("b", 3, 6), ("a", 0, 4)])[0].tolist() == [1, 2]
    assert tokens.attribute(start, end, [])[1:] == (0, 3)


def test_rows(spark, make_docs, odd_texts):
    got = {r.doc_id: r for r in tokens.count_tokens(make_docs(odd_texts)).collect()}
    encoding, _ = tokens.encoder(RANKS)
    for i, t in enumerate(odd_texts):
        r = got[i]
        assert r.n_tokens == len(encoding.encode_ordinary(t or "")) == sum(r.section_tokens) + r.n_outside
        assert r.n_outside == 0 and r.n_sections == len((t or "").splitlines() if "\n" in (t or "") else [t] * bool(t))
    assert tokens.count_tokens(make_docs([])).count() == 0


def test_fields(spark, make_docs):
    r = tokens.count_tokens(make_docs(["one two\nthree"], ids=[None]), fields=("source", "text")).first()
    assert r.doc_id is None and r.n_chars == len("src0\none two\nthree") and len(r.field_tokens) == 2
    assert r.field_tokens[1] == sum(r.section_tokens) and sum(r.field_tokens) + 1 >= r.n_tokens


@pytest.mark.parametrize("text", ["a" * 20_000, "\n" * 5000, "é" * 3000])
def test_long_runs(text):
    start, end = tokens.token_spans(text, RANKS)
    assert start[0] == 0 and end[-1] == len(text)


def test_query_fields_and_gaps_match_brute_force(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts[:11] + ["a b\n\n  \nc d\n"]).withColumn("n_tokens", F.lit("clash")).withColumn("f0", F.lit("clash"))
    for r in tokens.count_tokens(docs, ("source", "text"), tokens.bare_lines).collect():
        source, text = f"src{r.doc_id % 3}", (odd_texts[:11] + ["a b\n\n  \nc d\n"])[r.doc_id] or ""
        whole, begin = f"{source}\n{text}", len(source) + 1
        counts, crossing, outside = slow(whole, [(n, a + begin, b + begin) for n, a, b in tokens.bare_lines(text)])
        assert (r.section_tokens, r.n_crossing, r.n_outside) == (counts, crossing, outside)
        assert r.field_tokens == slow(whole, [("", 0, len(source)), ("", begin, len(whole))])[0]
