import pytest

from gristmill import profile as P
from gristmill.functions import model_output as M

TOML = """
name = "A. Example"
location = "Somewhere"
current_role = "Analyst"
background = "Reports"
goal = " Better reports "
target_roles = ["Analyst", "Engineer"]
languages = { english = "intermediate" }
[skills]
analytics = ["SQL", "Charts"]
[preferences]
salary_first = false
statement = "Remote only."
[application]
phone = "000"
"""


def test_a_profile_heads_prompts_without_what_forms_ask(tmp_path):
    (tmp_path / "profile.toml").write_text(TOML)
    got = P.load(tmp_path / "profile.toml")
    assert got.target_roles == ("Analyst", "Engineer") and got.skills == {"analytics": ("SQL", "Charts")} and got.application == {"phone": "000"}
    assert P.load(tmp_path / "profile.toml") is got
    text = M.prompt([{"signature": "s", "title": "t", "company": "c", "description": "d"}], got.head())
    assert "SKILLS: SQL, Charts" in text and "GOAL: Better reports" in text and "salary_first: no; Remote only." in text and "000" not in text


@pytest.mark.parametrize(
    ("change", "why"),
    [({"name": None}, "missing: name"), ({"target_roles": "x"}, "target_roles must be a list of strings"), ({"skills": {"a": "b"}}, "skills must be a table"), ({"other": 1}, "no such field: other"), ({"goal": 3}, "goal must be a string")],
)
def test_a_profile_that_cannot_be_used_says_why(change, why):
    data = {"name": "n", "location": "l", "current_role": "r", "background": "b", "goal": "g", "target_roles": []} | change
    with pytest.raises(P.BadProfile, match=why):
        P.from_table({k: v for k, v in data.items() if v is not None})
