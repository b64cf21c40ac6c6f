"""Words that cannot begin a feature are not decoded, and features are those of decoding every word."""

import random

from sieveline.llm import toxicity as T


def test_words_without_features_are_not_decoded(monkeypatch):
    cost = T.model(T.count_grams(["the stupid kettle boils better by the book and a bee sees an egg add ill off " * 20]))
    words = ["stupid$", "stup", "stupi", "book$", "book", "add$", "ill$", "of$", "a$", "bee$", "egg$", "kett", "éco"]
    only = {f: i for i, f in enumerate(words)}
    r = random.Random(4)
    some = ["stupid", "sttuupid", "s.t.u.p.i.d", "book", "boook", "b00k", "add", "adddd", "aadd", "i11", "off", "aa", "kettle", "keettlle", "letter", "ÉÉCO", "(egg)", "st upid", "$$$", "x"]
    some += ["".join(r.choice("aabeokdilsté.") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    told, every = T.Reader(cost, only), T.Reader(cost)
    for w in some:
        assert set(told[w]) == {only[f] for f in every[w] if f in only}, w
    read = []
    monkeypatch.setattr(T, "viterbi", lambda segment, cost: read.append(segment) or segment)
    fresh = T.Reader(cost, {f: i for i, f in enumerate(["stup", "stupid$"])})
    assert fresh["cheese"] == () and fresh["Butter,"] == () and read == []
    fresh["sttupid"]
    assert read == ["sttupid"]
