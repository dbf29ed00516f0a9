"""barloom: OHLCV analytics, indicator grids, signals and backtest search as Spark jobs."""
