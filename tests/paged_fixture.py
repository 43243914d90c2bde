"""Pages of numbers; each shard fails once with a slow-down error."""

_failed: set[int] = set()


def numbers(shard, shards, cursor):
    if shard not in _failed:
        _failed.add(shard)
        raise OSError("HTTP 429 too many requests")
    if cursor >= 10:
        return None
    return [(shard, shard + i * shards) for i in range(cursor, min(10, cursor + 4))], cursor + 4
