import pytest

from glyphaudit import report
from glyphaudit.__main__ import main


def test_rules_and_usage(capsys):
    assert main(["rules"]) == 0 and "missing-dir-attribute" in capsys.readouterr().out
    assert main(["scan", "x", "--scripts", "common"]) == 3


def test_splice():
    assert report.splice(f"a{report.BEGIN}old{report.END}b", "new") == "anewb"
    with pytest.raises(ValueError):
        report.splice(f"{report.END}{report.BEGIN}", "new")
