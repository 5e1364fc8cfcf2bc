"""A progressive JPEG reader from the standard's flow charts, one bit and one sample at a time; it shares nothing with the library."""

import math

_ORDER = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


class Bits:
    def __init__(self, data, at):
        self.data, self.at, self.left, self.byte = data, at, 0, 0

    def bit(self):
        if not self.left:
            self.byte = self.data[self.at]
            self.at += 2 if self.byte == 0xFF else 1  # a stuffed zero follows
            self.left = 8
        self.left -= 1
        return self.byte >> self.left & 1

    def number(self, n):
        v = 0
        for _ in range(n):
            v = 2 * v + self.bit()
        return v

    def signed(self, n):
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, codes):
        code, n = 0, 0
        while (n, code) not in codes:
            code, n = 2 * code + self.bit(), n + 1
        return codes[n, code]


def tables(body):
    out, i = {}, 0
    while i < len(body):
        slot, counts = body[i], body[i + 1 : i + 17]
        i, code, codes = i + 17, 0, {}
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                codes[n, code] = body[i]
                code, i = code + 1, i + 1
            code *= 2
        out[slot] = codes
    return out


def read(data):
    """Rows of (red, green, blue), as real numbers before rounding, and coefficient blocks of each component."""
    at, quants, huff, comps = 2, {}, {}, []
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], data[at + 2] * 256 + data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            for i in range(0, len(body), 65):
                quants[body[i]] = body[i + 1 : i + 65]
        elif marker == 0xC4:
            huff |= tables(body)
        elif marker == 0xC2:
            height, width = body[1] * 256 + body[2], body[3] * 256 + body[4]
            for i in range(6, len(body), 3):
                comps.append({"id": body[i], "h": body[i + 1] >> 4, "v": body[i + 1] & 15, "q": body[i + 2]})
            hm, vm = max(c["h"] for c in comps), max(c["v"] for c in comps)
            mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
            for c in comps:
                c["w"], c["rows"] = mx * c["h"], my * c["v"]
                c["blocks"] = [[[0] * 64 for _ in range(c["w"])] for _ in range(c["rows"])]
        elif marker == 0xDA:
            own = [(next(c for c in comps if c["id"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            bits, before, run = Bits(data, at), {}, 0
            if len(own) > 1:
                units = [(c, t, y * c["v"] + j, x * c["h"] + i) for y in range(my) for x in range(mx) for c, t in own for j in range(c["v"]) for i in range(c["h"])]
            else:
                c, t = own[0]
                units = [(c, t, y, x) for y in range(-(-(-(-height * c["v"] // vm)) // 8)) for x in range(-(-(-(-width * c["h"] // hm)) // 8))]
            for c, t, y, x in units:
                block = c["blocks"][y][x]
                if not ss:
                    if high:
                        block[0] |= bits.bit() << low
                    else:
                        before[c["id"]] = before.get(c["id"], 0) + bits.signed(bits.symbol(huff[t >> 4]))
                        block[0] = before[c["id"]] * (1 << low)
                    continue
                run = (later if high else earlier)(bits, block, huff[16 | t & 15], ss, se, low, run)
            at = bits.at
            while not (data[at] == 0xFF and data[at + 1] not in (0, 0xFF)):
                at += 1
    samples = [picture(c, quants[c["q"]]) for c in comps]
    rows = []
    for y in range(height):
        row = []
        for x in range(width):
            a, b, r = (s[y * c["v"] // vm][x * c["h"] // hm] for c, s in zip(comps, samples))
            row.append((a + 1.402 * (r - 128), a - 0.344136 * (b - 128) - 0.714136 * (r - 128), a + 1.772 * (b - 128)))
        rows.append(row)
    return rows, comps


def earlier(bits, block, codes, k, se, low, run):
    if run:
        return run - 1
    while k <= se:
        r, s = divmod(bits.symbol(codes), 16)
        if s:
            k += r
            block[k] = bits.signed(s) * (1 << low)
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) - 1 + bits.number(r)
    return 0


def later(bits, block, codes, k, se, low, run):
    def more(i):
        if bits.bit():
            block[i] += (1 << low) * (1 if block[i] > 0 else -1)

    while k <= se and not run:
        r, s = divmod(bits.symbol(codes), 16)
        new = 0
        if s:
            new = (1 << low) * (1 if bits.bit() else -1)
        elif r < 15:
            run = (1 << r) + bits.number(r)
            break
        while k <= se:
            if block[k]:
                more(k)
            elif r == 0:
                if new:
                    block[k] = new
                k += 1
                break
            else:
                r -= 1
            k += 1
    if run:
        for i in range(k, se + 1):
            if block[i]:
                more(i)
        return run - 1
    return 0


def picture(c, quant):
    """Samples of a component by the cosine sum."""
    cos = [[(math.sqrt(0.125) if not u else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for u in range(8)] for x in range(8)]
    out = [[0] * (8 * c["w"]) for _ in range(8 * c["rows"])]
    for by, line in enumerate(c["blocks"]):
        for bx, block in enumerate(line):
            f = [[0.0] * 8 for _ in range(8)]
            for k, (v, u) in enumerate(_ORDER):
                f[v][u] = block[k] * quant[k]
            part = [[sum(f[v][u] * cos[x][u] for u in range(8)) for x in range(8)] for v in range(8)]
            for y in range(8):
                for x in range(8):
                    s = sum(part[v][x] * cos[y][v] for v in range(8)) + 128
                    out[8 * by + y][8 * bx + x] = min(255, max(0, math.floor(s + 0.5)))
    return out
