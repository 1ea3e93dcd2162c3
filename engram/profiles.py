"""Which verbs a caller may use: three levels, then an allow list, then a deny list."""

from __future__ import annotations

from collections.abc import Iterable

from engram.errors import EngineError

LEVELS = ("read-only", "standard", "administrative")
# fixed values: the verbs by the least level that may use them
VERBS = {
    "read-only": "memory_recall memory_get memory_list memory_retrieve_episodes memory_search_skills memory_query_causal graph_get_node graph_query graph_k_hop graph_search_nodes session_get session_list memory_recommend_action memory_verify memory_stats memory_info".split(),
    "standard": "memory_remember memory_update memory_forget memory_store_episode memory_create_skill memory_record_skill_outcome memory_add_causal_edge memory_record_causal_outcome graph_create_node graph_create_edge graph_create_hyperedge graph_delete session_start session_append_turn session_end memory_record_outcome memory_snapshot memory_branch".split(),
    "administrative": "memory_learning memory_consolidate memory_compact memory_expire memory_restore memory_purge memory_reembed".split(),
}


def verbs(profile: str = "standard", allow: Iterable[str] | None = None, deny: Iterable[str] = ()) -> list[str]:
    """The verbs of a profile; the deny list wins."""
    if profile not in LEVELS:
        raise EngineError("INVALID_ARGUMENT", f"unknown profile {profile}")
    open_to = [v for level in LEVELS[: LEVELS.index(profile) + 1] for v in VERBS[level]]
    named = set(open_to) if allow is None else set(allow)
    return [v for v in open_to if v in named and v not in set(deny)]


def require(verb: str, profile: str = "standard", **lists) -> None:
    if verb not in verbs(profile, **lists):
        raise EngineError("UNSUPPORTED", f"{verb} is not open to this profile", profile=profile)
