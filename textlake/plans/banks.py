"""Sample banks for the given tables, in the four null/binary modes."""

from __future__ import annotations

from textlake.operators.bank import Bank, Template

NOISE = [
    "Careful records make later work easier.",
    "Many details are best read in context.",
    "A short pause helps the reader along.",
    "Such notes are kept for good order.",
    "Every entry deserves a second look.",
]


def customer_bank(null_mode: str = "implicit", binary_mode: str = "implicit") -> Bank:
    yes_no = binary_mode == "explicit"
    null = null_mode == "explicit"
    return [
        Template("c_custkey", ("The customer number is [C_CUSTKEY].", "This file concerns customer number [C_CUSTKEY].",
                               "Customer [C_CUSTKEY] is described here.")),
        Template("c_name", ("The customer on file is [C_NAME].", "This account belongs to [C_NAME].",
                            "Our papers list [C_NAME] as the holder.")),
        Template("c_mktsegment", ("The market segment is [C_MKTSEGMENT].", "It buys within the [C_MKTSEGMENT] segment.",
                                  "Business is done in [C_MKTSEGMENT].", "Trade falls under [C_MKTSEGMENT].")),
        Template("c_nationkey", ("The nation key is [C_NATIONKEY].", "Its home nation has key [C_NATIONKEY].")),
        Template("c_acctbal", ("The account balance is [C_ACCTBAL].", "A balance of [C_ACCTBAL] is held.",
                               "Funds stand at [C_ACCTBAL]."),
                 synonyms={"balance": ("balance", "saldo", "position")}),
        Template("is_debtor",
                 ("The debtor mark is [IS_DEBTOR].", "Debtor status reads [IS_DEBTOR].") if yes_no
                 else ("This customer is in debt.", "Money is owed by this customer."),
                 ("The debtor flag shows [IS_DEBTOR].",) if yes_no
                 else ("This customer is not in debt.", "No money is owed by this customer."),
                 variation_class="BINARY"),
        Template("channel", ("Orders arrive through [CHANNEL].", "The sales channel is [CHANNEL]."),
                 ("The sales channel is NULL.", "Orders arrive through NULL.") if null
                 else ("The sales channel is not specified.", "No channel was ever recorded."),
                 variation_class="NULL"),
        Template("opted_in",
                 ("The mail choice is [OPTED_IN].", "Mail opt in reads [OPTED_IN].") if yes_no
                 else ("The customer opted in to mail.", "Mail is welcome at this address."),
                 ("The mail choice shows [OPTED_IN].",) if yes_no
                 else ("The customer declined mail.", "Mail is not welcome at this address."),
                 ("The mail wish is NULL.",) if null else ("The mail wish is unknown.", "Nothing was said on mail.")),
    ]


ORDER_BANK: Bank = [
    Template("o_orderkey", ("The order number is [O_ORDERKEY].", "This note is about order [O_ORDERKEY].")),
    Template("o_custkey", ("It was placed by customer number [O_CUSTKEY].", "Customer number [O_CUSTKEY] placed it.")),
    Template("o_orderstatus", ("The order status is [O_ORDERSTATUS].", "Its state is [O_ORDERSTATUS].")),
    Template("o_totalprice", ("The total price is [O_TOTALPRICE].", "The price came to [O_TOTALPRICE].",
                              "In all [O_TOTALPRICE] was charged.")),
    Template("o_orderdate", ("The order date is [O_ORDERDATE].", "It was dated [O_ORDERDATE].")),
    Template("o_orderpriority", ("The priority is [O_ORDERPRIORITY].", "Handling follows [O_ORDERPRIORITY] rules.")),
]

NATION_BANK: Bank = [
    Template("n_nationkey", ("The nation number is [N_NATIONKEY].", "Nation [N_NATIONKEY] is meant here.")),
    Template("n_name", ("The nation is called [N_NAME].", "Its name is [N_NAME].")),
    Template("n_regionkey", ("The region number is [N_REGIONKEY].", "It lies in region [N_REGIONKEY].")),
]

PART_BANK: Bank = [
    Template("p_partkey", ("The part number is [P_PARTKEY].", "Part [P_PARTKEY] is described.")),
    Template("p_name", ("The part is a [P_NAME].", "It is sold as [P_NAME].")),
    Template("p_brand", ("The brand is [P_BRAND].", "It carries the [P_BRAND] brand.")),
    Template("p_size", ("The size is [P_SIZE].", "It measures [P_SIZE] units.")),
    Template("p_retailprice", ("The retail price is [P_RETAILPRICE].", "Shops ask [P_RETAILPRICE] for it.")),
]
