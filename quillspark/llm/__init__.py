"""Training-data operators: near neighbours, toxicity, personal data, repeats, chats, copies, quality, BPE, packing."""
