"""Search results of several sites as one stream of messages: each result once, as it arrives, and the end when all sites are done.

Every site is a stream of its own; their rows meet by search. The state of a
search holds what was sent and which sites have ended; it goes when its time is
over, so that a site that never ends doesn't hold its search for ever.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a site sends: a result (``product_id`` and ``payload``), that it has failed, or that it has no more. ``sites`` is how
#: many are asked, ``at`` when the row was made, ``place`` its place among the site's rows.
ITEM, ERROR, END = "item", "error", "end"
REPORT = "search_id long, user_id long, page int, sites int, site string, kind string, product_id string, payload string, place long, at timestamp"
MESSAGE = "search_id long, user_id long, page int, position long, type string, product_id string, payload string"
_STATE = "user_id long, page int, sent array<string>, ended array<string>, position long, finished boolean"
#: Minutes without a row after which a search ends by itself.
PATIENCE = 10


def reports(results: DataFrame, site: str | Column, searches: Column, user: Column, page: Column, sites: int, place: Column, at: Column, kind: str | Column = ITEM) -> DataFrame:
    """``REPORT`` of a site's rows; ``results`` of kind ``ITEM`` have ``product_id`` and ``image_url``, and those without an image aren't shown."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    if "product_id" in results.columns:
        results = results.where((kind != ITEM) | (F.coalesce("image_url", F.lit("")) != ""))
        ids, payload = F.col("product_id"), F.when(kind == ITEM, F.to_json(F.struct(*results.columns)))
    else:
        ids = payload = F.lit(None).cast("string")
    columns = {"search_id": searches, "user_id": user, "page": page, "sites": F.lit(sites), "site": F.lit(site) if isinstance(site, str) else site,
               "kind": kind, "product_id": ids, "payload": payload, "place": place, "at": at}
    types = dict(f.rsplit(" ", 1) for f in REPORT.split(", "))
    return results.select(*(c.cast(types[name]).alias(name) for name, c in columns.items()))


def messages(streams: list[DataFrame], patience: int = PATIENCE) -> DataFrame:
    """``MESSAGE`` rows of the sites' streams (``REPORT``): SEARCH_SUCCESS for each result when it first comes, SEARCH_ERROR where a
    site fails, and SEARCH_FINISHED, once, when all sites have ended or failed, or nothing came for ``patience`` minutes.

    ``position`` counts a search's messages. After its end nothing is sent for a search while its state is kept.
    """
    wait = patience * 60_000

    def follow(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        user, page, sent, ended, position, finished = state.get if state.exists else (None, None, [], [], 0, False)
        sent, ended = list(sent), list(ended)
        known, out = set(sent), []

        def say(kind: str, product=None, payload=None) -> None:
            nonlocal position
            out.append((key[0], user, page, position, kind, product, payload))
            position += 1

        if state.hasTimedOut:
            if not finished:
                say("SEARCH_FINISHED")
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "site", "place"], kind="stable")
            user, page = int(rows["user_id"].iloc[0]), int(rows["page"].iloc[0])
            for row in rows.itertuples(index=False):
                if finished:
                    break
                if row.kind == ITEM and row.product_id not in known:
                    known.add(row.product_id)
                    sent.append(row.product_id)
                    say("SEARCH_SUCCESS", row.product_id, row.payload)
                elif row.kind != ITEM and row.site not in ended:
                    ended.append(row.site)
                    if row.kind == ERROR:
                        say("SEARCH_ERROR", None, row.payload)
                    if len(ended) >= row.sites:
                        finished = True
                        say("SEARCH_FINISHED")
            state.update((user, page, sent, ended, position, finished))
            latest = int(rows["at"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in MESSAGE.split(", ")]).astype({"user_id": "Int64", "page": "Int32"})

    rows = reduce(DataFrame.unionByName, streams).withWatermark("at", "0 seconds")
    return rows.groupBy("search_id").applyInPandasWithState(follow, MESSAGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def send(messages: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """All that has come, to files under ``to``, each message once however often it is restarted."""
    return messages.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(to)
