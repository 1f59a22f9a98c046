"""Trade and holder reporting over on-chain collectible markets, on Spark."""
