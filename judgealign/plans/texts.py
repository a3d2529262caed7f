"""Short rubric texts for the registered queries. Real runs read their own (``read_rubric_table``)."""

from __future__ import annotations

from judgealign.operators.prompts import Rubric
from judgealign.schemas import ARCHETYPE_DIMS, REALISM_DIMS

REALISM = Rubric(
    {d: f"Rate {label} from 1 to 5." for d, _, label in REALISM_DIMS},
    {d: f"Rate {label} from 1 (poor) to 5 (excellent); anchors: 1 absent, 3 partly there, 5 throughout." for d, _, label in REALISM_DIMS[:8]},
)
ARCHETYPE = Rubric(
    {d: f"Rate {label}." for d, _, label in ARCHETYPE_DIMS},
    {d: f"Rate {label} in detail." for d, _, label in ARCHETYPE_DIMS},
)
EVENTS = Rubric({"click": "Rate the click.", "view": "Rate the view.", "error": "Rate the error."}, {"click": "Rate the click in detail."})
GENERAL = "Rate every dimension from 1 to 5."
GENERAL_DETAILED = "Rate every dimension from 1 to 5 in the given order."
CAPTION = "First describe the voice in <think> </think>."
EMOTION = "First describe the emotion in <think> </think>."
HEADERS = ["Rate one dimension.\n", "Judge the following aspect.\n", "Give one score.\n"]
SYSTEMS = ["You judge speech.", "You rate vocal delivery.", "You assess performances."]
OUTPUTS = ["OUTPUT <answer>1-5</answer>", "FORMAT <answer>1-5</answer>"]
