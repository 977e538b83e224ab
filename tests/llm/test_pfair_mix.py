import pytest

from terrazzo.llm import pfair_mix as p


def simulate(weights, blocks):
    done, base, t0, out = dict.fromkeys(weights, 0), dict.fromkeys(weights, 0), 0, []
    names = list(weights)
    while any(done[c] < blocks.get(c, 0) for c in names):
        act = [c for c in names if done[c] < blocks.get(c, 0)]
        total = sum(weights[c] for c in act)
        t = len(out) - t0
        ready = [(-(-(done[c] - base[c] + 1) * total // weights[c]), names.index(c), c) for c in act if (done[c] - base[c]) * total // weights[c] <= t]
        c = min(ready)[2]
        out.append((c, done[c]))
        done[c] += 1
        if done[c] == blocks[c]:
            t0, base = len(out), dict(done)
    return out


@pytest.mark.parametrize("weights,blocks", [({"a": 3, "b": 2, "*": 1}, {"a": 10, "b": 31, "*": 4}), ({"a": 1}, {"a": 5}), ({"a": 5, "b": 7, "c": 1}, {"a": 100, "b": 3, "c": 0})])
def test_phases_equal_slot_by_slot_simulation(weights, blocks):
    got = sorted((q.start + (k - q.first) // q.weight * q.total + q.at[(k - q.first) % q.weight], q.cls, k) for q in p.phases(weights, blocks) for k in range(q.first, q.last))
    assert [s for s, _, _ in got] == list(range(len(got)))
    assert [(c, k) for _, c, k in got] == simulate(weights, blocks)


def test_deviation_below_one_block():
    w = [7, 5, 4, 3, 1]
    slots = p.period(w) * 3
    for i, x in enumerate(w):
        done = 0
        for t, s in enumerate(slots, 1):
            done += s == i
            assert abs(done - t * x / sum(w)) < 1


def test_mix_places_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(p, "BUCKET_ROWS", 5)
    rows = [(i, "big" if i % 3 else "small", f"t{i}") for i in range(200)] + [(None, None, "t"), (None, "odd", None), (7, "big", "t7"), (7, "big", "t7")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    m = p.mix(df, {"big": 1, "small": 2}, block=4)
    got = m.collect()
    assert sorted(r["__position"] for r in got) == list(range(len(rows)))
    ordered = p.in_order(m, df.columns, 50)
    assert ordered.columns == df.columns
    assert sorted(map(str, ordered.collect())) == sorted(str(r) for r in df.collect())
    first = [r.source for r in ordered.collect()[:12]]
    assert first.count("small") in (4, 8) and first.count("big") in (0, 4)
    with pytest.raises(ValueError):
        p.mix(df, {"big": 0})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string")
    assert p.mix(df, {"a": 1}).count() == 0
    assert p.in_order(p.mix(df, {"a": 1}), df.columns).count() == 0
