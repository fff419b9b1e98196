"""keylake: Spark-native analytics over large collections of public keys, certificates and the corpora around them."""
