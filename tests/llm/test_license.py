"""License scans against a plain reading of the definition."""

import math
import random
import re
from itertools import pairwise

import pytest
from helpers import documents, frame

from acadspark.llm import license

TEMPLATES = (("x", "alpha beta gamma delta epsilon zeta"), ("y", "released under the terms of zeta"),
             ("z", "one two"), ("short", "alone"), ("x", "beta gamma beta gamma beta delta beta gamma kappa lambda"),
             ("same", "one two"))


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(rows, templates, containment, phrases=license.PHRASES):
    out = []
    for doc_id, text in rows:
        w = words_of(text)
        places, base = [], set()
        for phrase, label in phrases:
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, best = set(base), 0.0
        for label, t in templates:
            pairs = set(pairwise(t.split()))
            if not pairs:
                continue
            size = 4
            while size < len(t.split()):
                size *= 2
            for block in range(0, max(1, len(w)), size):
                # pairs that begin in the block's 2 * size words
                have = {(w[i], w[i + 1]) for i in range(block, min(block + 2 * size, len(w) - 1))}
                common = len(have & pairs)
                if common >= math.ceil(containment * len(pairs) - 1e-9):
                    labels.add(label)
                    best = max(best, common / len(pairs))
        out.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best))
    return sorted(out, key=repr)


def noisy(seed):
    """Notices with words lost, changed or added, in the middle of other words."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        w = [rng.choice(["alpha", "beta", "gamma", "zeta", "the", "of", "one"]) for _ in range(rng.randint(0, 40))]
        for _, t in rng.sample(TEMPLATES, 2):
            own = t.upper().split() if rng.random() < 0.3 else t.split()
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = own
        rows.append((i, rng.choice([" ", "\n", ", ", "\n\n* "]).join(w)))
    return rows


EDGE = [(200, "MIT\nLicense, mit-license; MIT licenses"), (201, "the Apache  License and the GNU General Public License."),
        (202, "mit"), (203, "licénse mit licénse"), (204, "mit license " * 3000), (204, "mit license " * 3000),
        (205, "İmit license Mİt license"), (206, "\x00mit\x7flicense{general_public:license"), (None, "mit license")]


@pytest.mark.parametrize("containment", [0.5, 0.8, 1.0])
def test_against_definition(spark, containment):
    rows = documents() + noisy(1) + EDGE
    got = [tuple(r) for r in license.scan(frame(spark, rows), TEMPLATES, containment).collect()]
    assert sorted(got, key=repr) == expected(rows, TEMPLATES, containment)


def test_own_templates_and_none(spark):
    rows = EDGE + [(300 + i, f"tail of {label} " + text + " and more") for i, (label, text) in enumerate(license.TEMPLATES)]
    got = [tuple(r) for r in license.scan(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == expected(rows, license.TEMPLATES, 0.8)
    for r in got:
        if r[0] is not None and r[0] >= 300:
            assert license.TEMPLATES[r[0] - 300][0] in r[6].split(",")
    got = [tuple(r) for r in license.scan(frame(spark, rows), ()).collect()]
    assert sorted(got, key=repr) == expected(rows, (), 0.8)
    assert license.scan(frame(spark, [])).collect() == []


def test_only_built_in_functions(spark):
    plan = license.scan(frame(spark, EDGE))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        license.scan(frame(spark, EDGE), containment=0.0)
