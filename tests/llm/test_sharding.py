import zlib
from collections import Counter, defaultdict

from lumenstack.llm.sharding import interleave_shards


def test_shards_match_the_mixture(documents):
    rows = interleave_shards(documents, 16).collect()
    assert len(rows) == documents.count()
    by_shard = Counter(r.shard for r in rows)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 16
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = Counter(r.source for r in rows)
    for shard in by_shard:
        mix = Counter(r.source for r in rows if r.shard == shard)
        assert all(abs(mix[s] - total[s] / 16) < 2 for s in total)


def test_seed_and_determinism(documents):
    a = {r.doc_id: (r.shard, r.slot) for r in interleave_shards(documents, 4, seed=1).collect()}
    assert a == {r.doc_id: (r.shard, r.slot) for r in interleave_shards(documents.repartition(3), 4, seed=1).collect()}
    assert a != {r.doc_id: (r.shard, r.slot) for r in interleave_shards(documents, 4, seed=2).collect()}


def test_odd_rows(odd_rows, empty):
    rows = interleave_shards(odd_rows, 3).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [4, 4, 4]
    null = next(r for r in rows if r.doc_id == 1)
    assert (null.size, null.text_crc32) == (1, zlib.crc32(b""))
    assert interleave_shards(empty, 3).count() == 0
