from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hiregrid.llm.packing import best_fit_pack, best_fit_plan, token_bytes
from hiregrid.llm.queries import TOKENIZER


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abc ABC'sté ñß12 ½²\n\t.,!?-–“”€"), st.characters()), max_size=30))
def test_ids_equal_the_tokenizers(text):
    table = token_bytes(TOKENIZER)
    assert np.frombuffer(table.ids(text), "<u4").tolist() == table.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 500), max_size=20))
def test_plan_is_best_fit_decreasing(counts):
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms[rooms.index(min(fit))] -= length
            else:
                rooms.append(64 - length)
    used = defaultdict(list)
    for length, lo, hi, first, each, offset in best_fit_plan(counts, 64):
        for r in range(lo, hi):
            used[first + (r - lo) // each].append((offset + (r - lo) % each * length, length))
    assert Counter(n for s in used.values() for _, n in s) == Counter({k: v for k, v in counts.items() if v})
    assert len(used) == len(rooms)
    assert sorted(64 - sum(n for _, n in s) for s in used.values()) == sorted(rooms)
    for s in used.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64


def check(got, rows, capacity=1024):
    table = token_bytes(TOKENIZER)
    want = Counter()
    for i, text, *_ in rows:
        ids = np.frombuffer(table.whole(text or ""), "<u4").tolist() + [2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(places) <= 1.05 * (total / capacity) + 2


def test_pack_over_awkward_rows(docs, clashing, empty, rows):
    for source in (docs, clashing):
        check(best_fit_pack(source, TOKENIZER).collect(), rows)
    assert best_fit_pack(empty, TOKENIZER).count() == 0


def test_many_equal_lengths(spark):
    rng = random.Random(3)
    rows = [(i, "word" * rng.randint(1, 3)) for i in range(9000)]
    got = best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).collect()
    check(got, rows)


def test_an_added_token_in_a_text_has_its_own_id():
    from tokenizers import Tokenizer

    fresh, table = Tokenizer.from_file(TOKENIZER), token_bytes(TOKENIZER)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>é", "<|endoftext|", "plain words, 12 of them"):
        want = fresh.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(table.ids(text), "<u4").tolist() == want
        assert (50256 in want) == ("<|endoftext|>" in text)
