"""Universes that are given as lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Sectors and tickers of the two universes, which share no ticker.
UNIVERSES = {
    "first": {
        "Technology": "AAPL MSFT NVDA GOOGL META ORCL CRM ADBE AMD INTC CSCO IBM",
        "Communication Services": "DIS NFLX CMCSA T VZ TMUS",
        "Healthcare": "JNJ UNH PFE ABBV MRK LLY TMO ABT DHR BMY",
        "Financials": "JPM BAC WFC GS MS V MA AXP BLK SCHW",
        "Consumer Discretionary": "AMZN TSLA HD MCD NKE SBUX LOW BKNG",
        "Consumer Staples": "PG KO PEP WMT COST CL MO",
        "Energy": "XOM CVX COP SLB EOG OXY",
        "Industrials": "BA CAT GE UPS HON LMT RTX",
        "Utilities": "NEE DUK SO D AEP",
        "Real Estate": "AMT PLD SPG O EQIX",
        "Materials": "LIN SHW FCX NEM APD",
    },
    "second": {
        "Technology": "QCOM TXN AVGO NOW INTU ADI AMAT MU LRCX",
        "Communication Services": "WBD PARA EA TTWO OMC",
        "Healthcare": "CVS CI HUM ELV MDT SYK BSX ISRG VRTX",
        "Financials": "C USB PNC TFC COF AIG MET PRU ICE",
        "Consumer Discretionary": "TJX ROST YUM CMG MAR HLT GM F",
        "Consumer Staples": "MDLZ KHC GIS KMB STZ EL",
        "Energy": "PSX MPC VLO WMB KMI",
        "Industrials": "MMM DE ETN EMR ITW NOC",
        "Utilities": "EXC XEL ED PEG WEC",
        "Real Estate": "PSA WELL DLR AVB EQR",
        "Materials": "ECL NUE DOW PPG ALB",
    },
}


def universe(spark: SparkSession, name: str) -> DataFrame:
    """(ticker, sector) of a universe, for joins; fewer than a hundred rows."""
    rows = [(ticker, sector) for sector, tickers in UNIVERSES[name].items() for ticker in tickers.split()]
    return spark.createDataFrame(rows, "ticker string, sector string")
