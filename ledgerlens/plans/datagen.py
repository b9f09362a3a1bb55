"""A seeded synthetic ledger with ordinary life, look-alikes and injected rings, and its truth.

Ordinary traffic is made by DataFrame functions from hashed counters, so it scales with
accounts and days and doesn't depend on partitions; the few rings and look-alikes are
made on the driver.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from functools import reduce
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Settings
from ..sources.ledger import LEDGER_SCHEMA, edges, write_bank_files

START, DAYS, PER_BANK = datetime(2026, 1, 1), 90, 400
#: Pairs of persons of a bank that pay each other, and pairs across banks.
PAIRS, ACROSS = 40, 80
#: First account numbers of a bank by role; the rest are persons.
ROLES = (("hq", 1), ("employer", 8), ("shop", 25), ("landlord", 6), ("utility", 3))


def account_roles(spark: SparkSession, per_bank: int = PER_BANK, banks: tuple[str, ...] = Settings().banks) -> DataFrame:
    n = F.col("id") % per_bank
    role, upto = F.lit(None).cast("string"), 0
    cases = []
    for name, k in ROLES:
        upto += k
        cases.append((upto, name))
    role = F.lit("person")
    for upto, name in reversed(cases):
        role = F.when(n < upto, name).otherwise(role)
    bank = F.element_at(F.array(*map(F.lit, banks)), (F.expr(f"id div {per_bank}") + 1).cast("int"))
    return spark.range(per_bank * len(banks)).select(F.col("id").alias("number"), F.format_string("%s_%04d", bank, n + 1).alias("account"), bank.alias("bank"), role.alias("role"))


def _uniform(seed: int, *key: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and key alone: the first 53 bits of their hash."""
    parts = [F.lit(k) if isinstance(k, str) else k.cast("long") for k in key]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / F.lit(2.0**53)


def _whole(u: Column, low: int, high: int) -> Column:
    """An integer in [low, high) of a uniform number."""
    return (F.floor(u * (high - low)) + low).cast("int")


def _lognormal(u: Column, v: Column, mean: float, deviation: float, most: float) -> Column:
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
    return F.least(F.exp(normal * deviation + mean), F.lit(most))


def _poisson(u: Column, rate: Column, most: int = 120) -> Column:
    """The number whose cumulative probability passes ``u``, up to ``most``: far above any rate used here."""
    start = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("c"))
    step = lambda a, k: F.struct(F.when(a["c"] < u, a["n"] + 1).otherwise(a["n"]).alias("n"), (a["p"] * rate / k).alias("p"), F.when(a["c"] < u, a["c"] + a["p"] * rate / k).otherwise(a["c"]).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["n"])


def ordinary_traffic(spark: SparkSession, seed: int = 42, noise: float = 1.0, per_bank: int = PER_BANK, banks: tuple[str, ...] = Settings().banks) -> DataFrame:
    """The payments of ordinary life, each drawn where it has its rate, by counters.

    Shops have a popularity and a number of purchases a day; employers a staff with a salary,
    a pay day, revenue from the head office and business expenses; landlords tenants;
    utilities payers; 40 pairs a bank pay each other now and then, and pairs across banks
    every eleventh day. A draw is a hash of (seed, kind, payer or place, day, number), so
    rows are made by explodes alone, wherever they are made.
    """
    size = {name: k for name, k in ROLES}
    begin, at = {}, 0
    for name, k in ROLES:
        begin[name], at = at, at + k
    persons = per_bank - at
    begin["person"], size["person"] = at, persons
    bank_name = F.array(*map(F.lit, banks))
    who = lambda bank, role, k: F.format_string("%s_%04d", F.element_at(bank_name, (bank + 1).cast("int")), F.lit(begin[role] + 1) + k)
    scaled = lambda n: n if noise == 1.0 else F.greatest(F.lit(1), F.round(n * noise).cast("int"))
    bank, k, day, i, month = (F.col(c) for c in ("bank", "k", "day", "i", "month"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    person = lambda u, b=bank: who(b, "person", _whole(u, 0, persons))

    def places(role: str, n: int | None = None) -> DataFrame:
        """``bank, k``: the numbered accounts of a role, or ``n`` a bank."""
        n = size[role] if n is None else n
        return spark.range(len(banks) * n).select(F.expr(f"cast(id div {n} as int)").alias("bank"), F.expr(f"cast(id % {n} as int)").alias("k"))

    def draws(kind: str, *key: Column):
        return lambda what: _uniform(seed, f"{kind}:{what}", *key)

    def paid(rows: DataFrame, kind: str, number: list[Column], src: Column, dst: Column, minute: Column, amount: Column, channel: Column | str, second: Column | int = 0) -> DataFrame:
        """Rows of the file schema; ``minute`` counts from START on."""
        t = F.timestamp_add("SECOND", (minute * 60 + second).cast("int"), F.lit(f"{START:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz"))
        name = F.concat_ws("-", F.lit(f"TXN{kind}"), *[n.cast("string") for n in number])
        c = F.lit(channel) if isinstance(channel, str) else channel
        return rows.select(name.alias("txn_id"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), src.alias("src_account"), dst.alias("dst_account"), F.round(amount, 2).alias("amount"), F.substring_index(src, "_", 1).alias("bank_src"), F.substring_index(dst, "_", 1).alias("bank_dst"), c.alias("channel"))

    out = []
    # Purchases: places x days x a Poisson number.
    u = draws("shop", bank, k)
    daily = places("shop").withColumn("rate", _whole(u("daily"), 2, 12) * (0.4 + 1.1 * u("popularity")) * noise).withColumn("day", each(F.lit(DAYS)))
    n = _poisson(_uniform(seed, "shop:n", bank, k, day), F.col("rate"))
    bought = daily.withColumn("n", n).where("n > 0").withColumn("i", each(F.col("n")))
    u = draws("buy", bank, k, day, i)
    channel = F.when(u("channel") < 0.5, "card").when(u("channel") < 0.8, "transfer").when(u("channel") < 0.95, "cash").otherwise("wire")
    out.append(paid(bought, "S", [bank, k, day, i], person(u("person")), who(bank, "shop", k), day * 1440 + _whole(u("minute"), 8 * 60, 22 * 60), _lognormal(u("a"), u("b"), 3.2, 0.9, 4000.0), channel))

    # Wages: the first of a bank's persons by hash, for each employer; the head office pays in what goes out.
    u = draws("employer", bank, k)
    staff = places("employer").withColumn("staff", F.least(scaled(_whole(u("staff"), 30, 70)), F.lit(persons))).withColumn("pay_day", _whole(u("pay_day"), 1, 28)).withColumn("salary", 2500 + 1600 * u("salary")).withColumn("i", each(F.lit(persons)))
    turn = F.row_number().over(W.partitionBy("bank", "k").orderBy(_uniform(seed, "staff", bank, k, i), "i"))  # a bank's persons
    wages = staff.withColumn("turn", turn).where("turn <= staff").withColumn("month", each(F.lit(DAYS // 30))).withColumn("day", F.col("pay_day") + 30 * month).where(day < DAYS)
    hour = day * 1440 + _whole(_uniform(seed, "wages:hour", bank, k, month), 9, 11) * 60 + _whole(_uniform(seed, "wages:minute", bank, k, month), 0, 59)
    u = draws("wage", bank, k, i, month)
    wages = wages.withColumn("at", hour).withColumn("wage", F.round(F.col("salary") * (0.9 + 0.2 * u("part")), 2))
    out.append(paid(wages, "W", [bank, k, i, month], who(bank, "employer", k), who(bank, "person", i), F.col("at") + _whole(u("minute"), 0, 240), F.col("wage"), "payroll"))
    revenue = wages.groupBy("bank", "k", "month", "at").agg(F.sum(F.col("wage").cast("decimal(18,2)")).cast("double").alias("wage"))
    out.append(paid(revenue, "H", [bank, k, month], who(bank, "hq", F.lit(0)), who(bank, "employer", k), F.col("at") - 120, F.col("wage"), "wire"))
    spent = places("employer").withColumn("i", each(F.lit(30) if noise == 1.0 else scaled(F.lit(30))))
    u = draws("expense", bank, k, i)
    out.append(paid(spent, "E", [bank, k, i], who(bank, "employer", k), who(bank, "shop", _whole(u("shop"), 0, size["shop"])), _whole(u("day"), 0, DAYS) * 1440 + _whole(u("minute"), 9 * 60, 18 * 60), 100 + 1400 * u("amount"), "card"))

    # Rent: the same tenant and amount each month.
    u = draws("landlord", bank, k)
    rented = places("landlord").withColumn("rent_day", _whole(u("day"), 1, 6)).withColumn("i", each(scaled(_whole(u("tenants"), 4, 12)))).withColumn("month", each(F.lit(DAYS // 30))).withColumn("day", F.col("rent_day") + 30 * month)
    u = draws("tenant", bank, k, i)
    out.append(paid(rented, "L", [bank, k, i, month], person(u("person")), who(bank, "landlord", k), day * 1440 + 600 + _whole(_uniform(seed, "rent:minute", bank, k, i, month), 0, 50), 700 + 1500 * u("amount"), "transfer"))

    used = places("utility").withColumn("day", each(F.lit(DAYS))).withColumn("i", each(scaled(_whole(_uniform(seed, "utility:n", bank, k, day), 5, 15))))
    u = draws("use", bank, k, day, i)
    out.append(paid(used, "U", [bank, k, day, i], person(u("person")), who(bank, "utility", k), day * 1440 + _whole(u("minute"), 7 * 60, 23 * 60), 40 + 220 * u("amount"), "transfer"))

    # Fixed pairs: the second person is another than the first.
    u = draws("pair", bank, k)
    one = _whole(u("one"), 0, persons)
    other = (one + 1 + _whole(u("other"), 0, max(1, persons - 1))) % persons
    pairs = places("person", PAIRS).withColumn("one", one).withColumn("other", other).withColumn("day", each(F.lit(DAYS))).where(_uniform(seed, "pair:day", bank, k, day) < 0.25 * noise)
    u = draws("between", bank, k, day)
    out.append(paid(pairs, "P", [bank, k, day], who(bank, "person", F.col("one")), who(bank, "person", F.col("other")), day * 1440 + _whole(u("minute"), 6 * 60, 24 * 60), _lognormal(u("a"), u("b"), 4.0, 1.0, 5000.0), "transfer"))

    n_across = max(1, round(ACROSS * noise)) if noise != 1.0 else ACROSS
    u = draws("across", k)
    left = _whole(u("bank"), 0, len(banks))
    right = (left + 1 + _whole(u("other"), 0, max(1, len(banks) - 1))) % len(banks)
    across = spark.range(n_across).select(F.col("id").cast("int").alias("k")).withColumn("left", left).withColumn("right", right).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1), F.lit(11))))
    v = draws("transfer", k, day)
    out.append(paid(across, "X", [k, day], person(u("one"), F.col("left")), person(u("two"), F.col("right")), day * 1440 + _whole(v("minute"), 9 * 60, 18 * 60), 200 + 2800 * v("amount"), "wire"))
    return reduce(DataFrame.unionByName, out)


class _Ring:
    def __init__(self, seed: int, per_bank: int) -> None:
        self.rng, self.rows, self.n, self.per_bank = Random(seed), [], 0, per_bank
        self.free = [f"{b}_{k + 1:04d}" for b in Settings().banks for k in range(per_bank, per_bank + 200)]  # accounts of their own, without ordinary traffic
        self.rng.shuffle(self.free)

    def take(self, n: int) -> list[str]:
        out, self.free = self.free[:n], self.free[n:]
        return out

    def pay(self, src: str, dst: str, t: datetime, amount: float, channel: str = "transfer") -> str:
        self.n += 1
        key = f"RNG{self.n:06d}"
        self.rows.append((key, t.strftime("%Y-%m-%d %H:%M:%S"), src, dst, round(float(amount), 2), src.split("_")[0], dst.split("_")[0], channel))
        return key

    def moment(self) -> datetime:
        return START + timedelta(days=self.rng.uniform(5, DAYS - 12), hours=self.rng.uniform(8, 20))

    def cycle(self, i: int) -> dict:
        who, t, a = self.take(self.rng.randint(3, 6)), self.moment(), self.rng.uniform(8_000, 40_000)
        fee, start, ids = self.rng.uniform(0.005, 0.02), t, []
        for s, d in zip(who, [*who[1:], who[0]]):
            if self.rng.random() >= 0.18 or s == who[0] or d == who[0]:  # some hops stay hidden
                ids.append(self.pay(s, d, t, a, "wire"))
            a *= (1 - fee) * self.rng.uniform(0.98, 1.0)
            t += timedelta(minutes=self.rng.uniform(20, 600))
        return {"ring_id": f"T-CYCLE-{i:02d}", "type": "cycle", "accounts": who, "origin": who[0], "start": str(start), "end": str(t), "txn_ids": ids}

    def chain(self, i: int) -> dict:
        who, t, a, ids = self.take(self.rng.randint(4, 7)), self.moment(), self.rng.uniform(5_000, 30_000), []
        start = t
        for s, d in zip(who, who[1:]):
            ids.append(self.pay(s, d, t, a, "wire"))
            a *= self.rng.uniform(0.9, 0.98)
            t += timedelta(minutes=self.rng.uniform(1, 90))
        return {"ring_id": f"T-CHAIN-{i:02d}", "type": "mule_chain", "accounts": who, "origin": who[0], "terminal": who[-1], "start": str(start), "end": str(t), "txn_ids": ids}

    def smurf(self, i: int) -> dict:
        n, t0 = self.rng.randint(15, 40), self.moment()
        collector, *exits = self.take(3)
        payers = self.take(n)
        ids = [self.pay(payers[k % len(payers)], collector, t0 + timedelta(hours=self.rng.uniform(0, 140)), 10_000 * self.rng.uniform(0.85, 0.995), "cash") for k in range(n)]
        total = sum(r[4] for r in self.rows[-n:])
        for k, x in enumerate(exits):
            self.pay(collector, x, t0 + timedelta(hours=150 + 5 * k), total * (0.5, 0.4)[k], "wire")
        return {"ring_id": f"T-SMURF-{i:02d}", "type": "smurfing", "collector": collector, "depositors": payers, "exits": exits, "start": str(t0), "end": str(t0 + timedelta(hours=160)), "txn_ids": ids}

    def normal_life(self, who: list[str]) -> None:
        for a in who:
            if self.rng.random() < 2 / 3:
                for _ in range(self.rng.randint(2, 6)):
                    self.pay(a, f"{a.split('_')[0]}_{self.rng.randint(10, 34):04d}", self.moment(), self.rng.uniform(10, 200), "card")

    def decoys(self) -> list[dict]:
        """Seven ordinary accounts that look like rings."""
        busy, roll, home, kitty, flt, l1, l2 = who = self.take(7)
        people = self.take(40)
        for k in range(300):
            self.pay(self.rng.choice(people), busy, self.moment(), self.rng.uniform(20, 400), "card")
        for m in range(3):
            for p in people[:20]:
                self.pay(roll, p, START + timedelta(days=30 * m + 27, hours=9), 3000, "payroll")
            for p in people[:15]:
                self.pay(p, home, START + timedelta(days=30 * m + 2, hours=10), 950, "transfer")
        for p in people[:12]:
            self.pay(p, kitty, self.moment(), self.rng.uniform(20, 60))
        for p in people[:12]:
            self.pay(flt, p, self.moment(), self.rng.uniform(100, 500))
        for k in range(10):
            t = START + timedelta(days=8 * k + 1)
            self.pay(l1, l2, t, 500)
            self.pay(l2, l1, t + timedelta(hours=30), 480)
        kinds = ("busy shop", "payroll", "landlord", "kitty", "payout float", "loop", "loop")
        return [{"account": a, "label": k, "looks_like": "smurfing" if k in ("busy shop", "landlord", "kitty") else "cycle" if k == "loop" else "mule_chain", "is_criminal": False} for a, k in zip(who, kinds)]


def generate(spark: SparkSession, seed: int = 42, noise: float = 1.0, per_bank: int = PER_BANK, rings: int = 5) -> tuple[DataFrame, dict]:
    """``(edges, truth)``: the ledger and a truth document of ``rings`` of each type and seven look-alikes."""
    r = _Ring(seed, per_bank)
    truth = {"cycles": [r.cycle(i + 1) for i in range(rings)], "mule_chains": [r.chain(i + 1) for i in range(rings)], "smurfing": [r.smurf(i + 1) for i in range(rings)]}
    for kind in truth.values():
        for t in kind:
            r.normal_life(t.get("accounts") or [t["collector"], *t["depositors"]])
    truth["decoys"] = r.decoys()
    injected = spark.createDataFrame(r.rows, LEDGER_SCHEMA)
    ledger = ordinary_traffic(spark, seed, noise, per_bank).unionByName(injected)
    return edges(ledger.withColumn("timestamp", F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")))), truth


def bootstrap(spark: SparkSession, path: str, seed: int = 42, noise: float = 1.0, per_bank: int = PER_BANK) -> str:
    """Bank files and a truth document below ``path``, made if there are none yet; returns the files' pattern."""
    files, done = f"{path}/banks/bank=*", spark._jvm.org.apache.hadoop.fs.Path(f"{path}/truth/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        made, truth = generate(spark, seed, noise, per_bank)
        write_bank_files(made, f"{path}/banks")
        spark.createDataFrame([(truth_json(truth),)], "doc string").coalesce(1).write.mode("overwrite").text(f"{path}/truth")
    return files


def truth_json(truth: dict) -> str:
    return json.dumps(truth)
