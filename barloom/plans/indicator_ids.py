"""Ids of all indicator definitions, so that queries can be named without a session (a test holds them against the registry)."""

IDS = """
candle_body candle_body_atr candle_body_pct candle_lower_wick candle_lower_wick_atr candle_lower_wick_pct candle_range candle_range_atr candle_stats
candle_stats_atr_norm candle_upper_wick candle_upper_wick_atr candle_upper_wick_pct distance_to_ma_norm ma.dema ma.ema ma.hma ma.lwma ma.rma ma.sma
ma.smma ma.tema ma.vwma ma.wma ma.zlema momentum.cci momentum.fisher momentum.macd momentum.ppo momentum.roc momentum.rsi momentum.stoch
momentum.stoch_rsi momentum.trix momentum.williams_r percent_rank pivot_high pivot_low pivots trend.adx trend.aroon trend.chandelier_exit
trend.donchian trend.ichimoku trend.keltner trend.linreg_slope trend.psar trend.supertrend trend.vortex volatility.atr volatility.bbands
volatility.bbands_bandwidth volatility.bbands_percent_b volatility.hv volatility.stddev volatility.tr volatility.variance volume.ad_line volume.cmf
volume.mfi volume.obv volume.volume_sma volume.vwap volume.vwap_deviation zscore
""".split()
