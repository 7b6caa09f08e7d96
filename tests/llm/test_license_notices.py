import textwrap

import pytest

from sourceloom.llm import licenses

NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
}


def _families(text):
    return {licenses.FAMILIES[f] for _, f, _, _ in licenses.classifier().scan(text.encode())[1]}


@pytest.mark.parametrize("width", [24, 40, 72])
@pytest.mark.parametrize("family", NOTICES)
def test_wrapped_notices(family, width):
    wrapped = "\n".join(" * " + x for x in textwrap.wrap(NOTICES[family], width))
    assert _families(f"/*\n * bomi teral 2020\n *\n{wrapped}\n *\n * anothen hetion\n */\nint main() {{ }}\n") == {family}


@pytest.mark.parametrize("family", NOTICES)
def test_notices_inside_long_lines(family):
    filler = " ".join(f"word{k % 97}x" for k in range(400))
    assert _families(f"{filler} {NOTICES[family]} {filler}") == {family}
    assert _families(f"{filler} Released under the MIT License. {filler} Licensed under CC BY-NC 4.0. {filler}") == {"mit", "cc-by-nc"}
    assert _families(f"{filler} Released under the MIT, {filler} Licensed under the MIT License, {filler}") == {"mit"}


def test_no_notice_over_blank_lines_or_in_talk():
    first, last = NOTICES["mit"].split(" obtaining ")
    assert not _families("Permission is hereby granted\n\nfree of charge\n\nto any person\n\nobtaining a copy of this\n\nsoftware and associated")
    assert not _families("the license of the driver is under the seat and the version of the public software is free " * 30)
    assert licenses.classifier().scan(f"a b\nc\n \n\t\n{first} obtaining {last}\n\n".encode())[0] == 2


def test_classifier_alone_on_held_out_paragraphs():
    import random

    from sourceloom.llm.decontaminate import word_ids

    rng = random.Random(99)
    made = [licenses._made(rng) for _ in range(800)]
    model = licenses.classifier()
    scores = model.scores([word_ids(t.encode()) for t, _ in made])
    told = [int(s.argmax()) if s.max() >= model.thresholds[s.argmax()] else -1 for s in scores[:, : licenses.LIKE]]
    right = sum(a == b for a, (_, b) in zip(told, made) if b >= 0)
    assert right >= 0.85 * sum(1 for _, b in made if b >= 0)
    assert sum(a >= 0 and a != b for a, (_, b) in zip(told, made)) <= 0.02 * sum(a >= 0 for a in told)


def test_unknown_class(spark):
    filler = " ".join(f"word{k % 97}x" for k in range(200))
    rows = [(1, f"{filler}\n\nThis work is licensed under the Artistic License 2.0\n\n{filler}"), (2, f"{filler}\n\nReleased under the MIT License.\n\n{filler}"), (3, filler), (4, None)]
    found = {r.doc_id: (r.n_paragraphs, r.families, r.n_unknown, r.unknown) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (3, "", 1, [1]), 2: (3, "mit", 0, []), 3: (1, "", 0, []), 4: (0, "", 0, [])}


def test_long_paragraphs_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(licenses, "PART_WORDS", 300)
    filler = " ".join(f"word{k % 97}x" for k in range(1000))
    for k in (150, 280, 296, 301):
        words = filler.split()
        assert _families(" ".join(words[:k] + NOTICES["mit"].split() + words[k:])) == {"mit"}
        assert _families("\n\n".join([" ".join(words[:k]), NOTICES["bsd"], " ".join(words)])) == {"bsd"}
