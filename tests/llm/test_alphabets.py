"""Language ID on wide alphabets: packed automata say what dense ones say, in little memory."""

import random
import subprocess
import sys

from vigil.llm import langid

WIDE = """
import random, resource, sys
sys.path.insert(0, {repo!r})
from vigil.llm import langid
rng = random.Random(1)
made = [(name, "".join(chr(base + rng.randrange(3000)) for _ in range(24_000))) for name, base in (("a", 0x4E00), ("b", 0x5E00), ("c", 0xAC00))]
model = langid.Model(tuple(made))
found = model.predict([t[500 * k : 500 * k + 200] for k, (_, t) in enumerate(made)])[0]
print(found == ["a", "b", "c"], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_three_wide_alphabets():
    repo = str(__import__("pathlib").Path(__file__).resolve().parents[2])
    right, mb = subprocess.run([sys.executable, "-c", WIDE.format(repo=repo)], capture_output=True, text=True, timeout=300).stdout.split()
    assert right == "True" and int(mb) < 1000


def test_packed_equals_dense(monkeypatch):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    made = tuple((name, " ".join(word(letters) for _ in range(900))) for name, letters in (("x", "abcdefgh"), ("y", "efghijkl"), ("z", "äöüßéабвгд中文字")))
    texts = ["", " 12 ", "?", *[" ".join(word("abcdefghijklmäöабв中文") for _ in range(rng.randint(1, 300))) for _ in range(120)]]
    dense = langid.Model(made)
    monkeypatch.setattr(langid, "DENSE", 0)
    packed = langid.Model(made)
    assert dense.dense and not packed.dense and dense.predict(texts) == packed.predict(texts)
    assert (dense.phrases([dense.symbols(langid._points(t)) for t in texts]) == packed.phrases([packed.symbols(langid._points(t)) for t in texts])).all()


def test_nothing_learned(monkeypatch):
    monkeypatch.setattr(langid, "DENSE", -1)
    assert langid.Model(()).predict(["abc"]) == (["und"], [0.0])
