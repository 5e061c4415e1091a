"""Properties that hold for any input."""

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.operators import deident, diff, jobs
from paperloom.operators.lists import OPS, simplify
from paperloom.sources.files import decode, page_spec

texts = st.text(max_size=60)


@settings(max_examples=100, deadline=None)
@given(texts, texts)
def test_a_diff_rebuilds_both_texts(a, b):
    rows, n = diff.align(a, b)
    assert [r[0] for r in rows if r[1] != "blank"] == a.splitlines()
    assert [r[2] for r in rows if r[3] != "blank"] == b.splitlines()
    assert n["added"] == sum(r[3] == "insert" for r in rows) and n["removed"] == sum(r[1] == "delete" for r in rows)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(0, 5), st.integers(0, 5))
def test_masks_keep_the_length(value, head, tail):
    assert len(deident.keep_edges(value, head, tail)) == len(value)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A123456789", "jane@x.org", "0912-345-678", " ", "x", "10.0.0.1", "4111 1111 1111 1111"]), max_size=8))
def test_redaction_keeps_length_and_spans_stay_inside(parts):
    text = " ".join(parts)
    spans = deident.find_spans(text, [deident.PATTERNS[i] for i in deident.DEFAULT])
    assert len(deident.rewrite(text, spans, "redact")) == len(text)
    for kind, _, _, value, _, start, end in spans:
        assert text[start:end] == value
        assert not any(o[0] == kind and o[5] <= start and end <= o[6] and o[5:7] != (start, end) for o in spans)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([{"op": n} for n in OPS] + [{"op": "?"}]), max_size=8))
def test_simplifying_twice_is_simplifying_once(ops):
    assert simplify(simplify(ops)) == simplify(ops)


@given(st.binary(max_size=40))
def test_decoding_never_fails(data):
    assert isinstance(decode(data), str)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=6), st.integers(1, 20))
def test_page_specs_name_existing_pages(pages, count):
    assert page_spec(",".join(map(str, pages)), count) == [p for p in pages if p <= count]


@given(st.lists(st.one_of(st.integers(-3, 30), st.text(max_size=2)), max_size=40))
def test_priorities_are_few_and_distinct(users):
    out = jobs.clean_priorities(users)
    assert len(out) <= 15 and len(set(out)) == len(out) and all(u > 0 for u in out)
