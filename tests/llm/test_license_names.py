"""op9 names: every template among all others, relatives told apart, negations."""

import itertools

import pytest

from annolake.llm import licenses


def names(text):
    return [f.name for f in licenses.scan(text)]


def test_every_ordered_pair_of_templates():
    """Two texts in a row, with prose around: each is named, nothing else."""
    wrong = []
    for x, y in itertools.product(licenses.TEMPLATES, repeat=2):
        found = names(f"Some words stand first. {licenses.TEMPLATES[x]} And a few more words of prose stand in between them here. {licenses.TEMPLATES[y]} At last others.")
        if found != [x, y]:
            wrong.append((x, y, found))
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_templates_survive_small_edits(name):
    words = licenses.TEMPLATES[name].split()
    keep = {w.lower().strip('.,;:()"') for w in licenses.DECIDING.get(name, ())}
    edited = [w if len(words) < 20 or k % 12 or any(d in w.lower() for d in keep) else "Xyzzy" for k, w in enumerate(words)]
    assert names("Before. " + " ".join(edited).upper() + " After.") == [name]


@pytest.mark.parametrize(("text", "found"), [
    ("Not released under the MIT License", []), ("This is no longer released under the MIT License.", []), ("There is no charge. Released under the MIT License", ["MIT-notice"]),
    ("This work is licensed under the GNU General Public License, version 2", ["GPL-2.0"]), ("This work is licensed under the GNU Affero General Public License, version 3", ["AGPL-3.0"]),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", ["CC-BY-NC-4.0-notice"]), ("This work is licensed under the Creative Commons Attribution 3.0 Unported License", []),
    ("Licensed under CC BY-NC-ND 4.0", ["CC-BY-NC-ND-4.0"]), ("Licensed under the Apache License, Version 1.1", []), ("This work is licensed under the GNU General Public License", []),
])
def test_relatives_are_told_apart(text, found):
    assert names(text) == found


def test_relatives_within_whole_notices():
    gpl = licenses.TEMPLATES["GPL-3.0-notice"]
    assert names(gpl.replace("GNU General", "GNU Affero General")) == ["AGPL-3.0-notice"]
    assert names(gpl.replace("version 3", "version 2")) == ["GPL-2.0-notice"]
    assert names(gpl.replace("version 3", "version 4")) == []
    assert names(licenses.TEMPLATES["BSD-3-Clause"]) == ["BSD-3-Clause"]
