"""Every form that a license rule matches passes the rule's gate."""

import re

import pytest

from palimpsest.llm import license_rules, license_scan


def forms(parsed):
    """Texts that a parsed pattern matches, one for each choice that it leaves."""
    out = [""]
    for op, av in parsed:
        match str(op):
            case "LITERAL":
                some = [chr(av)]
            case "IN":
                some = [c for kind, x in av for c in ([chr(x)] if str(kind) == "LITERAL" else [chr(x[0]), chr(x[1])] if str(kind) == "RANGE" else ["x"])]
            case "BRANCH":
                some = [x for part in av[1] for x in forms(part)]
            case "SUBPATTERN":
                some = forms(av[3])
            case "MAX_REPEAT" | "MIN_REPEAT":
                some = ([""] if av[0] == 0 else []) + forms(av[2])
        out = [a + b for a in out for b in some]
    return out


def test_gates_pass_whatever_their_rules_match():
    for label, gate, kinds in license_rules.families():
        for pattern in (p for patterns in kinds.values() for p in patterns):
            for form in forms(re._parser.parse(pattern)):
                assert re.fullmatch(pattern, form)
                assert set(form.split()) & set(gate), (label, form)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("licensed under GPLv3", "gpl-3.0"),
        ("AGPLv3", "agpl-3.0"),
        ("FreeBSD License", "bsd-2-clause"),
        ("Creative Commons Zero", "cc0-1.0"),
        ("Internet Systems Consortium License", "isc"),
        ("Responsible AI License", "openrail"),
        ("https://opendatacommons.org/licenses/by/", "odc-by-1.0"),
        ("Unauthorized copying of this file, via any medium, is strictly prohibited", "proprietary"),
    ],
)
def test_forms_without_another_gate_word(text, label):
    assert label in license_scan.scan_text(text)[5].split(",")
