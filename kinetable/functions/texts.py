"""Question texts. The wordings are fixed values: answers and audits match on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import one_decimal

#: Parts of the question texts.
FRAMES = ("The ", " frames are consecutive samples from one basketball clip spanning ", " seconds, in chronological order. ")
PRIOR = "Assume a typical player on this court is {:.2f} m tall. "
NUMBER_ONLY = " Output only the number, one decimal place."
LETTER_ONLY = " Output only the single uppercase letter."
ASK = {
    "speed": "What is the average speed of the player marked with the red box, in meters per second?",
    "path": "How far does the player marked with the red box travel along the floor over the whole clip, in meters?",
    "time": "If the player marked with the red box keeps moving at the speed they have in this clip, how many seconds until they reach the current position of the ball (marked with the yellow circle)?",
    "accel": "Comparing the second half of the clip with the first half, is the player marked with the red box: (A) speeding up (B) slowing down?",
    "accel_swapped": "Comparing the second half of the clip with the first half, is the player marked with the red box: (A) slowing down (B) speeding up?",
    "faster": "Which of the two is moving faster over this clip: (A) the player in the red box (B) the player in the blue box?",
}
#: What the pixel variant says instead, and the sentence of the ruler variant.
PIXEL_ASK = {
    "speed": "What is the average speed of the player marked with the red box across the image, in pixels per second?",
    "path": "How far does the player marked with the red box move across the image over the whole clip, in pixels?",
}
RULER = ("In these frames, one meter on the floor spans about ", " pixels. ")
#: The questions of the controlled arms, by family, and their unit words.
ARM_ASK = {
    "speed": ("What is the average speed of the player marked with the red box, in ", " per second?"),
    "path": ("What is the path length of the player marked with the red box over the whole clip, in ", "?"),
}
UNIT_WORDS = {"m": "meters", "cm": "centimeters", "px": "pixels"}
#: Full names of the families.
CATEGORIES = {"speed": "dynamics_speed_player", "path": "dynamics_path_player", "time": "dynamics_time_intercept", "accel": "relational_reasoning_dyn_accel", "accel_vis": "relational_reasoning_dyn_accel_vis", "faster": "relational_reasoning_dyn_faster"}
#: A prior sentence, as a pattern.
#: The height that a question names.
NAMED_HEIGHT = r"is ([0-9.]+) m tall"
ANY_PRIOR = r"\s*Assume a typical player on this court is [0-9.]+\s*m tall\.\s*"


def lead(n_frames, dur: Column) -> Column:
    return F.concat(F.lit(FRAMES[0]), F.lit(str(n_frames)), F.lit(FRAMES[1]), one_decimal(dur), F.lit(FRAMES[2]))


def numeric_question(family: Column, dur: Column, n_frames: int = 4, height_m: float | None = 1.93) -> Column:
    """Question of the speed, path and time families; ``height_m`` None leaves the prior sentence out."""
    ask = F.when(family == "speed", ASK["speed"]).when(family == "path", ASK["path"]).when(family == "time", ASK["time"])
    return F.concat(lead(n_frames, dur), F.lit(PRIOR.format(height_m) if height_m else ""), ask, F.lit(NUMBER_ONLY))


def letter_question(ask: Column, dur: Column, n_frames: int = 4) -> Column:
    return F.concat(lead(n_frames, dur), ask, F.lit(LETTER_ONLY))


def arm_question(family: Column, unit: Column, prior: Column, dur: Column, n_frames: int = 4, height_m: float = 1.93) -> Column:
    """Question of a controlled arm: only the unit's word and the prior sentence differ between arms."""
    word = F.when(unit == "m", UNIT_WORDS["m"]).when(unit == "cm", UNIT_WORDS["cm"]).otherwise(UNIT_WORDS["px"])
    ask = F.when(family == "speed", F.concat(F.lit(ARM_ASK["speed"][0]), word, F.lit(ARM_ASK["speed"][1]))).otherwise(F.concat(F.lit(ARM_ASK["path"][0]), word, F.lit(ARM_ASK["path"][1])))
    return F.concat(lead(n_frames, dur), F.when(prior, PRIOR.format(height_m)).otherwise(""), ask, F.lit(NUMBER_ONLY))


#: Wording of a clip's frames and of a single frame.
SINGLE_FRAME = (r"The [0-9]+ frames are consecutive samples from one basketball clip spanning ([0-9.]+) seconds, in chronological order\.", "This is a single frame from a basketball clip spanning $1 seconds.")


def single_frame_question(question: Column) -> Column:
    """The wording for one frame; other questions stay as they are."""
    return F.regexp_replace(question, *SINGLE_FRAME)


def with_reference_text(question: Column, reference: str) -> Column:
    """A question after a text that everybody may read."""
    return F.concat_ws("\n\n", F.lit(reference.strip()), question)


#: The second turn of the two-stage form, by family: before and after the own answer, and the unit words.
SECOND_TURN = {
    "path": ("The player marked with the red box has a path length of ", " meters over the clip. ", " Express that path length in "),
    "speed": ("The player marked with the red box moves at an average speed of ", " meters per second. ", " Express that speed in "),
}


def second_turn(family: Column, raw: Column, sentence: str, path_unit: str, speed_unit: str) -> Column:
    """The next question of a two-stage form: the own first answer verbatim, then the factor and the unit asked for."""
    text = lambda f, unit: F.concat(F.lit(SECOND_TURN[f][0]), F.trim(F.coalesce(raw, F.lit(""))), F.lit(SECOND_TURN[f][1] + sentence + SECOND_TURN[f][2] + unit + "." + NUMBER_ONLY))
    return F.when(family == "path", text("path", path_unit)).otherwise(text("speed", speed_unit))
