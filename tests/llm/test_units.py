"""Units found in bytes are those that the pattern finds, and a store that forgets keeps the arcs of what it holds."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stavework.llm import common, gumbel_encode
from stavework.llm.common import TOKENIZERS, file_bytes
from stavework.llm.lattice import Vocabulary

MODEL = file_bytes(f"{TOKENIZERS}/piece_bpe_32k.model")
VOCABULARY = Vocabulary(MODEL)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.none() | st.text(alphabet=" \n▁ab\té日\x00 🙂", max_size=12), max_size=6))
def test_units_in_bytes_are_those_of_the_pattern(texts):
    codes, units, per_text = VOCABULARY.coded_units(texts)
    found = np.split(np.array(units, object)[codes], np.cumsum(per_text)[:-1]) if texts else []
    assert len(set(units)) == len(units)
    assert [list(x) for x in found] == [VOCABULARY.units_of(t) for t in texts]


def test_forgetting_keeps_frequent_units_as_they_were():
    lattices = gumbel_encode.Lattices(MODEL, 0.0005, store=300)

    def arcs(unit):
        a, base = lattices.arrays, lattices.base[unit]
        nodes = range(base, base + len(unit))
        spans = [range(a["head"][n], a["head"][n] + a["degree"][n]) for n in nodes]
        return [[(a["target"][x] - base, a["source"][x] - base, a["id"][x], a["logp"][x], a["leave"][x], a["cum"][x]) for x in s] for s in spans]

    for _ in range(3):
        lattices.nodes_of(["▁there", "▁of"])
    lattices.nodes_of(["▁interesting", "▁elsewhere"])
    before = {u: arcs(u) for u in ("▁there", "▁of")}
    lattices.forget()
    assert set(lattices.base) == {"▁there", "▁of"} and {u: arcs(u) for u in lattices.base} == before
    assert lattices.n_arcs == sum(len(x) for u in before for x in before[u])
    start = lattices.nodes_of(["▁of", "▁elsewhere", "▁there"])
    assert [lattices.arrays["length"][n] for n in start] == [3, 10, 6]
    lattices.store = 0
    lattices.forget()
    assert not lattices.base and lattices.n_arcs == lattices.n_nodes == 0
    assert len(lattices.nodes_of(["▁of"])) == 1


def test_a_store_at_rest_is_small_and_samples_stay_the_same():
    lattices = gumbel_encode.Lattices(MODEL, 0.0005, store=300)
    texts, keys = ["there is of interesting", "elsewhere of 日 there\nthere"], np.array([3, 4], np.uint64)
    sample = lambda: [[(gumbel_encode.token_ids(lattices, p[0]).tolist(), *p[1:]) for p in own] for own in gumbel_encode.sample_texts(texts, keys, lattices, 2)]
    before = sample()
    assert len(lattices.arrays["logp"]) > lattices.n_arcs
    lattices.rest()
    assert lattices.n_arcs <= 150 and all(len(a) <= max(1, lattices.n_arcs, lattices.n_nodes) for a in lattices.arrays.values())
    assert sample() == before
    lattices.rest()
    assert sample() == before


def test_memory_is_released_after_the_last_batch(monkeypatch):
    freed = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: type("Library", (), {"malloc_trim": lambda self, n: freed.append(n)})())
    assert list(common.releasing(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and freed == [0]
