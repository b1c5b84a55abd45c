import random

from llm_cases import frame, prose
from test_near_copies import plain_shingles

import corpus_pipeline as P
from loomspan.llm import simhash


def test_simhash_links_drop_what_shingles_keep(spark):
    """Pairs at 3 or fewer bits whose shingle sets are below 0.8 go too, and chains over both kinds of links are one."""
    rng, rows = random.Random(3), []
    print_of = lambda t: simhash.fingerprint(t.encode())
    for k, text in enumerate(prose(77, 60)):
        base = [f"{w}{i % 7}" for i, w in enumerate((text + " " + text).split())][:400]
        # the whole once more, many times over, then own words: shingles as sets differ by a fifth and more, counts do not
        own = [f"own{k}x{i}" for i in range(len(base) // 2)]
        left, right = " ".join(base * 12), " ".join(base * 12 + own)
        rows += [(2 * k + 1, left, "en", "s", len(left)), (2 * k, right, "en", "s", len(right))]
    assert dict(P.STAGES)["near dedup"] is P.drop_near_duplicates
    linked = [k for k in range(60) if (print_of(rows[2 * k][1]) ^ print_of(rows[2 * k + 1][1])).bit_count() <= 3]
    assert linked
    for k in linked:
        a, b = (plain_shingles(rows[2 * k + j][1]) for j in range(2))
        assert 5 * len(a & b) < 4 * len(a | b)
    k = linked[0]
    near = rows[2 * k][1] + " tail"  # linked to the left text by shingles; its own id is the smallest of the three
    rows.append((-1, near, "en", "s", len(near)))
    rng.shuffle(rows)
    kept = {r.doc_id for r in P.drop_near_duplicates(spark, frame(spark, rows), "").collect()}
    assert kept == {-1} | {r[0] for r in rows} - {2 * k, 2 * k + 1} - {2 * j + 1 for j in linked}
