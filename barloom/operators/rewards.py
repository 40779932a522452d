"""Rewards of every step of a ledger, by model name.

A step that sold is judged by what the sale made, one that bought by what the entry promises, other steps by how the
position or the price moved. In all of them "in position" means after the step's action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import in_chunks, running

#: Multipliers that the models use, all 1 unless given.
MULTIPLIERS = [
    "combo_noaction", "combo_wrongaction", "combo_positionprofitpercentage", "combo_buy", "combo_sell", "combo_sell_profit", "combo_sell_profit_prev", "combo_sell_perfect",
    "combo_sell_drawdown", "combo_buy_profit", "combo_buy_perfect", "combo_buy_profitable_offset", "combo_buy_profitable", "combo_buy_drawdown", "combo_hold_profit", "combo_hold_drawdown",
]


def step_reward(name: str, multipliers: dict[str, float] | None = None, balance: float = 100_000.0) -> Column:
    """Reward of a ledger row that has next_price, prev_price, prev_net_worth, and the label columns where the model needs them.

    A name that no model has is the plain profit.
    """
    m = dict.fromkeys(MULTIPLIERS, 1.0) | (multipliers or {})
    c = F.col
    profit = c("net_worth") / balance - 1
    change = c("net_worth") / c("prev_net_worth") - 1
    ahead, behind = c("next_price") / c("price") - 1, c("price") / c("prev_price") - 1
    sold, bought, held = c("sold"), c("bought"), c("in_position")
    if name == "combo":
        perfect = lambda x: F.when(x, 1.0).otherwise(0.0)
        sale = profit * m["combo_sell_profit"] + change * m["combo_sell_profit_prev"] + perfect(c("signal_buy_sell") < -1) * m["combo_sell_perfect"] + c("drawdown") * m["combo_sell_drawdown"]
        entry = profit * m["combo_buy_profit"] + perfect(c("signal_buy_sell") > 1) * m["combo_buy_perfect"] + (m["combo_buy_profitable_offset"] - c("signal_buy_profitable")) * m["combo_buy_profitable"] + c("signal_buy_drawdown") * m["combo_buy_drawdown"]
        hold = F.when(held, ahead).otherwise(-ahead) * m["combo_hold_profit"] + c("drawdown") * m["combo_hold_drawdown"]
        return F.when(sold, sale).when(bought, entry).otherwise(hold)
    if name in ("combo_all", "combo_all2"):
        scolds = F.lit(name == "combo_all2")
        growth = (profit - (c("prev_net_worth") / balance - 1)) * m["combo_positionprofitpercentage"]
        inside = growth + F.when(scolds & (c("action") == 1), m["combo_wrongaction"]).otherwise(0.0)
        outside = F.when(scolds & (c("action") == 2), F.lit(float(m["combo_wrongaction"]))).otherwise(behind * m["combo_noaction"])
        return F.when(sold, profit * m["combo_sell"]).when(bought, ahead * m["combo_buy"]).when(held, inside).when(c("ord") > 1, outside).otherwise(0.0)
    if name in ("buy_sell_signal", "buy_sell_signal2", "buy_sell_signal3", "buy_sell_signal4"):
        toward = F.when(held, ahead).otherwise(-ahead)
        rest = {"buy_sell_signal": F.lit(0.0), "buy_sell_signal2": toward, "buy_sell_signal3": c("drawdown"), "buy_sell_signal4": toward + c("drawdown")}[name] * m["combo_positionprofitpercentage"]
        return F.when(sold, profit * F.when(c("signal_buy_sell") < -1, 1.1).otherwise(1.0) * 100).when(bought & (c("signal_buy_sell") > 1), 1.0).otherwise(rest)
    if name in ("profit_all", "profit_all2"):
        sale = change + profit if name == "profit_all2" else profit
        # Flat: the same cash is worth more of the asset as the price falls.
        return F.when(sold, sale).when(bought, profit).when(held, change).otherwise(c("prev_price") / c("price") - 1)
    scaled = name in ("profit_percentage2", "profit_percentage3", "profit_percentage4")
    out = F.when(F.lit(scaled) & c("made") & ((c("action") == 2) | (c("reason") == -1)), profit * m["combo_sell"])
    if name in ("profit_percentage3", "profit_percentage4"):
        out = out.when(~held, (1 - c("next_price") / c("price")) * m["combo_positionprofitpercentage"])
    if name == "profit_percentage4":
        out = out.when(held, ahead)
    return out.otherwise(profit)


def rewards(ledger: DataFrame, name: str, multipliers: dict[str, float] | None = None, balance: float = 100_000.0, keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """ledger with reward (null where it needs a bar that there isn't) and total_reward."""
    near = in_chunks(ledger, lambda w: {"next_price": F.lead("price").over(w), "prev_price": F.lag("price").over(w), "prev_net_worth": F.coalesce(F.lag("net_worth").over(w), F.lit(balance))}, before=1, after=1, key=keys)
    return running(near.withColumn("reward", step_reward(name, multipliers, balance)), {"total_reward": F.coalesce("reward", F.lit(0.0))}, key=keys)
