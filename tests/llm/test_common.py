from pathlib import Path

from framewright.llm import common, neardup


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_tidy_gives_memory_back():
    """What a task frees in the middle of its heap leaves the process when the task ends; batches pass unchanged."""
    kept, held = [], []

    def run(batches):
        for batch in batches:
            blocks = [bytes(3000) for _ in range(60_000)]
            kept.extend(blocks[999::1000])  # so free() alone returns nothing
            held.append(resident())
            yield batch

    before = resident()
    assert list(common.tidy(run)(iter([1, 2]))) == [1, 2]
    assert held[-1] - before > 120e6 and resident() - before < 0.3 * (held[-1] - before)
    assert list(common.tidy(run)(iter([]))) == []


def test_tidy_in_every_python_step():
    """Steps of the near-duplicate search run for long beside others: none keeps what it has freed."""
    code = Path(neardup.__file__).read_text()
    assert code.count(".mapInArrow(") == code.count(".mapInArrow(tidy(") > 0
