"""Distribution strategies shared by the operators: ordered series, recurrences, ranks, quantiles, pair sums."""
