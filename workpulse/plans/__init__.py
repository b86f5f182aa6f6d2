"""The four reports: cases, payments, value chain and its versions."""
