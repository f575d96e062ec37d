import random
import re

import pyarrow as pa

from quarrylane.llm import answers as A
from quarrylane.llm import languages
from quarrylane.llm import truncation as T


def test_faster_forms_find_the_same():
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab-.,019 ٣٤½\n—") for _ in range(40)) for _ in range(400)] + ["--1-2,3.4-", "1.,2", "-", ""]
    assert all(T._DIGITS.sub("0", x) == re.sub(r"-?\d+(?:[.,]\d+)*", "0", x) for x in texts)
    shared = T._shared(pa.array(["same " * 9, None, "same " * 9, ""]))
    assert shared == ["same " * 9, None, "same " * 9, ""] and shared[0] is shared[2]

    class Counting:
        seen = 0

        def finditer(self, text):
            for m in re.finditer("#", text):
                self.seen += 1
                yield m

    for n, more in ((0, False), (2, False), (3, True), (50, True)):
        c = Counting()
        assert A._more(c, "#" * n, 2) is more and c.seen == min(n, 3)


def test_sure_counts_each_language():
    p = languages.profiles()
    own = {k: {w for w in languages._WORDS.findall(t.lower())} for k, t in languages.SAMPLES.items()}
    rnd = random.Random(8)
    for _ in range(200):
        k, j = rnd.sample(sorted(own), 2)
        words = rnd.choices(sorted(own[k]), k=rnd.randrange(60)) + rnd.choices(sorted(own[j]), k=rnd.randrange(4)) + ["zzz"]
        only = {x: {w for w in own[x] if all(w not in own[y] for y in own if y != x)} for x in own}
        n, other = sum(w in only[k] for w in words), sum(any(w in only[x] for x in own if x != k) for w in words)
        assert p.sure(k, words) == (n >= languages.LEAST_WORDS and n >= languages.SURE * other)
    assert p.sure(None, ["the"]) is False
