"""The factorisation is not cut short."""

from tallyloom.llm import subjects


def test_all_rounds_and_steps_are_run():
    assert subjects.ROUNDS >= 8 and subjects.ROW_STEPS >= 12
