"""Near copies that share buckets of many centres are compared one pair a member and turn."""

from pathweave.llm import minhash as H


def test_connected_members_are_not_compared_again(spark, monkeypatch):
    n, centres = 60, 12
    sets = spark.createDataFrame([(i, b"") for i in range(n)], "node long, members binary")
    pairs = spark.createDataFrame([(a, b) for b in range(n) for a in range(min(b, centres))], "a long, b long")
    asked = []

    def all_similar(pairs, sets, percent):
        asked.append(pairs.count())
        return pairs

    monkeypatch.setattr(H, "confirmed", all_similar)
    links, label = H._star_links(pairs, sets, 75)
    assert sum(asked) < 2 * n and links.count() < 2 * n
    assert {r.component for r in label.collect()} == {0} and label.count() == n


def test_every_pair_is_asked_or_connected(spark, monkeypatch):
    pairs = [(a, b) for b in range(40) for a in range(b) if (a * 7 + b) % 3]
    similar = {(a, b) for a, b in pairs if a % 4 == b % 4}
    monkeypatch.setattr(H, "confirmed", lambda p, s, percent: p.sparkSession.createDataFrame(
        [r for r in map(tuple, p.select("a", "b").collect()) if r in similar], "a long, b long"))
    _, label = H._star_links(spark.createDataFrame(pairs, "a long, b long"), None, 75)
    got = {r.node: r.component for r in label.collect()}
    root = list(range(40))
    for _ in range(40):
        for a, b in similar:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(i, i) == root[i] for i in range(40))


def test_components_do_not_read_an_edge_in_each_round(spark, monkeypatch):
    """A star whose leaves settle at once and a chain that takes rounds: the star is told once, not once a round."""
    leaves, chain = 3_000, 200
    links = spark.createDataFrame([(0, i) for i in range(1, leaves + 1)] + [(10_000 + i, 10_001 + i) for i in range(chain)], "a long, b long")
    told, join = [], type(links).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "b":
            told.append(out.count())
        return out

    monkeypatch.setattr(type(links), "join", counted)
    got = {r.node: r.component for r in H.components(links).collect()}
    assert got == {i: 0 for i in range(leaves + 1)} | {10_000 + i: 10_000 for i in range(chain + 1)}
    assert len(told) > 3 and sum(told) < 2 * (leaves + 2 * chain * len(told))
