"""Near names are found through common shortenings, not by comparing all."""

import random

from lexforge.plans import parse


def test_near_names_without_comparing_all(monkeypatch):
    dice = random.Random(3)
    word = lambda n: "".join(dice.choice("bgdzklmnrst") + dice.choice("aeiou") for _ in range(n))
    said = [f"{word(dice.randrange(2, 5))}-{word(dice.randrange(2, 7))}" if i % 2 else word(dice.randrange(2, 9)) for i in range(2000)]
    names = parse.Names([(w, "") for w in said[:40]], [(w, "", said[i % 40]) for i, w in enumerate(said)])
    asked = [s.replace("-", " ") for s in said[::40]] + [s[:-2].replace("-", " ") for s in said[7::40]] + [f"{word(4)} {word(3)}" for _ in range(50)]
    within, calls = parse.distance_within, []
    monkeypatch.setattr(parse, "distance_within", lambda *a: calls.append(a) or within(*a))
    found = [names.section_by_key(*q.split()) for q in asked]
    assert len(calls) < 20 * len(asked)
    for q, got in zip(asked, found):
        key = "|".join(map(parse.plain_fold, q.split()))
        exact = [x for x in names.spelled.get(q, ()) if isinstance(x, parse.Section)]
        if len(exact) == 1 or len(names.section_keys.get(key, ())) == 1:
            assert got[0] is not None and not got[1]
            continue
        near = [(d, k) for k in names.section_keys if (d := within(key, k, 2 if len(key) >= 6 else 1)) is not None]
        best = {s for d, k in near if d == min(near)[0] for s in names.section_keys[k]}
        assert got == ((best.pop(), True) if len(best) == 1 else (None, False))
    assert sum(x is not None and fuzzy for x, fuzzy in found) > 5
