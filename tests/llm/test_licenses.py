import re

from larder.llm import licenses

PLAIN = {"MIT": "released under the mit license", "Apache-2.0": "licensed under the apache license version 2.0", "GPL-3.0": "this work is licensed under the gnu general public license version 3", "CC-BY-NC-4.0": "licensed under cc by-nc 4.0"}


def test_documents_equal_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((r.doc_id, r.license) for r in licenses.find_licenses(docs).collect())
    want = sorted((r.doc_id, k) for r in docs.collect() for k, p in PLAIN.items() for _ in re.findall(p, " ".join(licenses.words_of(r.text))))
    assert got == want and got


def names(text):
    return [r["license"] for r in licenses.scan(text)]


def test_cases():
    assert names(None) == names("") == names("a permission to licence nothing") == []
    assert names("Released  under\nthe MIT   License") == ["MIT"]
    assert names("Licensed under the Apache License, Version 3.0.") == []
    assert names("Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0.") == ["CC-BY-SA-4.0", "CC-BY-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    long = "noise words here " * 20_000
    assert names(long + "Licensed under the Apache License, Version 2.0. " + long) == ["Apache-2.0"]
    assert names("license " * 3000 + "Released under the MIT License. " + "license " * 3000) == ["MIT"]
    grant = licenses.TEMPLATES[2][1].replace("any person", "any human person")
    found = licenses.scan(grant)
    assert [r["license"] for r in found] == ["MIT"] and found[0]["differing"] == "+human" and found[0]["n_differing"] == 1
    text = "see: Released under the MIT License. bye"
    row = licenses.scan(text)[0]
    assert text[row["start"] : row["end"]] == "Released under the MIT License"


def test_tables(spark):
    rows = [(1, "Released under the MIT License.", "l"), (1, "Released under the MIT License.", "l"), (None, "Licensed under CC BY 4.0.", ""), (2, None, None), (3, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    assert sorted(((r.doc_id, r.license) for r in licenses.find_licenses(df).collect()), key=str) == [(1, "MIT"), (1, "MIT"), (None, "CC-BY-4.0")]
    assert licenses.find_licenses(df.where("false")).collect() == []


def prose(rng, n, triggers=("licence", "copyright", "permission", "license")):
    """n ordinary words, with one that starts a block every 30."""
    usual = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people mr how too little state good very make world still own see men work long here get both between life being under never day same another know while last might us great old year off come since against go came right used take three".split()
    return [rng.choice(triggers) if i % 30 == 15 else rng.choice(usual) for i in range(n)]


def test_notices_beside_other_words():
    """Exact notices in blocks of ordinary words, whatever the size of the block."""
    import random

    rng = random.Random(5)
    for size in (81, 150, 400, 1000):
        for name, text in licenses.TEMPLATES:
            for _ in range(3):
                words = prose(rng, size)
                at = rng.randrange(size)
                got = licenses.scan(" ".join([*words[:at], text, *words[at:]]))
                assert [(r["license"], r["n_differing"]) for r in got] == [(name, 0)], (size, text, got)


def test_every_allowed_wording_saves_enough():
    """The saving that is asked for before the wording is compared drops none with the words allowed to differ."""
    import random

    rng, (plain, _, made) = random.Random(6), licenses._templates(licenses.TEMPLATES)
    for _, own, _, held, packer in made:
        free = [i for i, w in enumerate(own) if not licenses.deciding(w)]
        for _ in range(200):
            words = list(own)
            for i in rng.sample(free, min(len(free), int(licenses.DIFFERING * len(own)))):
                words[i] = rng.choice(["zebra", "quite", "other"])
            around = prose(rng, len(own))
            at = rng.randrange(len(around) + 1)
            raw = " ".join([*around[:at], *words, *around[at:]]).encode()
            assert len(plain.compress(raw)) - len(packer.compress(raw)) >= licenses.HELD * held


def test_templates_are_an_argument(spark):
    long = "Permission to study, copy and teach from these notes is given to every reader " + " ".join(f"clause{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    df = spark.createDataFrame([(1, "Some words. " + long + " More words."), (2, "Released under the MIT License.")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in licenses.find_licenses(df, templates=(("Notes", long),)).collect()] == [(1, "Notes")]
