import pytest

from engram import profiles
from engram.errors import EngineError


def test_levels_and_lists():
    assert sum(map(len, profiles.VERBS.values())) == 41
    assert "memory_recall" in profiles.verbs("read-only") and "memory_remember" not in profiles.verbs("read-only")
    assert set(profiles.verbs("read-only")) < set(profiles.verbs()) < set(profiles.verbs("administrative"))
    assert profiles.verbs("standard", allow=["memory_recall", "memory_purge"], deny=[]) == ["memory_recall"]
    assert "memory_recall" not in profiles.verbs(deny=["memory_recall"])
    with pytest.raises(EngineError):
        profiles.require("memory_purge")
    with pytest.raises(EngineError):
        profiles.verbs("root")
