"""Rows beside which others once came out wrong."""

from __future__ import annotations

import resource

import pyarrow as pa
from corpora import prose

from triptally.llm import chat_format, compression, packing


def test_turns_do_not_depend_on_their_neighbours(spark):
    """A text that ends with the beginning of a control string, before one that goes on with it."""
    pairs = [("a#", "##b"), ("a##", "#b"), ("x</tu", "rn>y"), ("<", "/turn>"), ("\\", "###")]
    rows = [(i, j, "user", text) for i, pair in enumerate(pairs) for j, text in enumerate(pair)]
    rows += [(100 + 2 * i + j, 0, "user", text) for i, pair in enumerate(pairs) for j, text in enumerate(pair)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    sizes = {r.conv_id: r.formatted_chars for r in chat_format.chat_digests(chat_format.format_chats(frame)).collect()}
    for i, _ in enumerate(pairs):
        assert sizes[i] == sizes[100 + 2 * i] + sizes[101 + 2 * i]
    out, *_ = chat_format.assemble(pa.array(["u", "u"]), pa.array(["a#", "##b"]), ())
    assert out.tobytes() == b"### u: a#</turn>\n### u: ##b</turn>\n"


def test_a_very_long_turn_is_read_back_in_bounded_memory():
    text = ("plain words < and \\ more " * 800_000).encode()  # 20 MB
    column = pa.array([text.decode()])
    out, *_ = chat_format.assemble(pa.array(["user"]), column, ())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((role, back),) = chat_format.read_back(out.tobytes())
    assert (role, back) == (b"user", text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB


def test_packing_keeps_large_keys_beside_null(spark):
    keys = [None, 2**53 + 1, 2**53 + 2, -(2**62) - 1]
    docs = spark.createDataFrame([(k, f"some words {i}") for i, k in enumerate(keys)], "doc_id long, text string")
    packed = packing.pack_documents(docs).collect()
    assert {r.doc_id for r in packed} == set(keys) and len(packed) == 4


def test_samples_of_rows_without_key_are_bounded(spark):
    import random

    rng = random.Random(1)
    rows = [(None if i % 6 else i, prose(rng, 8) + str(i), "en") for i in range(6_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert 200 < len(compression.sample_by_class(frame, "lang", "text", "doc_id", 400, 4000)) < 700
