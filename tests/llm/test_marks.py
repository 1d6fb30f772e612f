"""What could be a placeholder reaches the classifier, however long and in any case."""

import pytest

from cordonlake.llm.residue import _marks

LONG = "the full legal name and the registered office of the supplying party"


@pytest.mark.parametrize("mark", [f"[Insert {LONG}]", f"(Insert {LONG})", "(Insert name)", "(YOUR NAME)", "todo: name", f"{{{{ {LONG} }}}}", f"{{% {LONG} %}}", f"<% {LONG} %>", f"${{{LONG}}}", f"[[{LONG}]]", f"<<{LONG}>>", f"«{LONG}»", f"<!-- {LONG} -->"])
def test_long_and_worded_marks(mark):
    assert mark in [m.group() for m in _marks(f"Between {mark}, and others.\nNext line.")]


def test_marks_end_with_their_line():
    assert not list(_marks("open [Insert the name\nof the party]"))
