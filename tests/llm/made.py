"""Made documents and benchmark items for the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _made() -> list[tuple]:
    """Documents with copies, near copies, shared passages, personal data, long, empty and null texts."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) for _ in range(900)] + ["é" * 3, "Größe", "日本語", "𝒳𝒴"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, base = prose(60), prose(150)
    texts = [None, "", "   \n ", "one", "one", "Two words", "word " * 300, "a" * 9000, base, base, base.upper()]
    for i in range(40):
        w = base.split()
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
        texts.append(" ".join(w))
    texts += [f"{prose(80)} {passage} {prose(60)}" for _ in range(12)]
    texts += [prose(rng.randint(1, 400)) for _ in range(30)]
    texts += [f"{prose(30)} mail a.b+c@example.com, 10.0.0.256 10.1.2.3 4111 1111 1111 1111 +1 (743) 555-3824 {prose(9)}\nReleased under the MIT License.", 'x token = "0123456789abcdef0123" y, ssn 123-45-6789.']
    texts += ["\n".join(["same line here"] * 5 + ["another | line"]), "Licensed under the Apache License, Version 2.0.\nGNU General Public License", prose(30_000), " ".join(["é日"] * 3000)]
    return [(i, t, "en", f"src{min(i % 7, 3)}", None if t is None else len(t)) for i, t in enumerate(texts)]


ROWS = _made()
ITEMS = [(1, " ".join((ROWS[8][1] or "").split()[20:45])), (2, "mit license"), (10, None), (3, "  "), (4, "nothing of this kind stands anywhere in these documents at all today"), (5, ROWS[8][1].split()[3]), (1, "twice given")]
