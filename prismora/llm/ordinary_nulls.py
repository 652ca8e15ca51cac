"""Written by ordinary.py."""

NULLS = {
    'decimal': {16: (0.4901, -0.5506, -0.0354, -1.5916), 18: (0.5298, -0.5734, -0.0763, -1.6418), 20: (0.477, -0.5858, -0.0664, -1.8188), 22: (0.4786, -0.5494, -0.0279, -1.9266), 24: (0.4879, -0.5655, -0.1323, -1.9737), 28: (0.4306, -0.5212, -0.0648, -2.2903), 32: (0.4156, -0.5162, -0.0629, -2.499), 40: (0.4161, -0.564, -0.0515, -2.8932), 48: (0.3498, -0.4937, -0.0274, -3.2088), 64: (0.2836, -0.4368, 0.0432, -3.7733)},
    'hex': {16: (0.2217, -0.8966, 0.6661, -3.5064), 18: (0.2238, -0.9581, 0.7362, -3.8423), 20: (0.1959, -0.8312, 0.6841, -3.8479), 22: (0.1829, -0.7783, 0.6422, -3.9356), 24: (0.1836, -0.7462, 0.6491, -4.0936), 28: (0.1487, -0.6893, 0.6075, -4.2634), 32: (0.1412, -0.6474, 0.6126, -4.5207), 40: (0.1095, -0.6451, 0.5982, -4.9952), 48: (0.0926, -0.6209, 0.6117, -5.3284), 64: (0.0623, -0.5802, 0.5996, -5.8966)},
    'HEX': {16: (0.2217, -0.8966, 0.6661, -3.5064), 18: (0.2238, -0.9581, 0.7362, -3.8423), 20: (0.1959, -0.8312, 0.6841, -3.8479), 22: (0.1829, -0.7783, 0.6422, -3.9356), 24: (0.1836, -0.7462, 0.6491, -4.0936), 28: (0.1487, -0.6893, 0.6075, -4.2634), 32: (0.1412, -0.6474, 0.6126, -4.5207), 40: (0.1095, -0.6451, 0.5982, -4.9952), 48: (0.0926, -0.6209, 0.6117, -5.3284), 64: (0.0623, -0.5802, 0.5996, -5.8966)},
    'lower': {16: (0.3443, 1.2955, -0.0178, -3.4907), 18: (0.3658, 1.2754, -0.0463, -3.7257), 20: (0.3802, 1.2806, -0.0235, -3.9812), 22: (0.4003, 1.3471, -0.0613, -4.2448), 24: (0.4614, 1.4677, -0.1049, -4.658), 28: (0.3994, 1.2263, -0.0933, -4.7469), 32: (0.4194, 1.2331, -0.0742, -5.2356), 40: (0.4915, 1.3553, -0.0868, -6.3441), 48: (0.4022, 1.1429, -0.0821, -6.4177), 64: (0.4396, 1.1608, -0.0567, -7.881)},
    'upper': {16: (0.3443, 1.2955, -0.0178, -3.4907), 18: (0.3658, 1.2754, -0.0463, -3.7257), 20: (0.3802, 1.2806, -0.0235, -3.9812), 22: (0.4003, 1.3471, -0.0613, -4.2448), 24: (0.4614, 1.4677, -0.1049, -4.658), 28: (0.3994, 1.2263, -0.0933, -4.7469), 32: (0.4194, 1.2331, -0.0742, -5.2356), 40: (0.4915, 1.3553, -0.0868, -6.3441), 48: (0.4022, 1.1429, -0.0821, -6.4177), 64: (0.4396, 1.1608, -0.0567, -7.881)},
    'base32': {16: (0.4434, -1.2139, 0.1502, -2.5197), 18: (0.4527, -1.2095, 0.1621, -2.8046), 20: (0.4749, -1.1975, 0.1691, -2.9602), 22: (0.4859, -1.187, 0.176, -3.0947), 24: (0.4463, -1.091, 0.1803, -3.1927), 28: (0.4811, -1.0877, 0.2285, -3.513), 32: (0.473, -1.0034, 0.1771, -3.7993), 40: (0.4313, -0.87, 0.1683, -4.0806), 48: (0.4192, -0.8335, 0.1939, -4.5162), 64: (0.3958, -0.7898, 0.2369, -5.3203)},
    'base36': {16: (0.269, -1.3353, 0.4504, -3.9573), 18: (0.2509, -1.1428, 0.3996, -3.9089), 20: (0.2816, -1.3463, 0.5184, -4.4609), 22: (0.2886, -1.3478, 0.5272, -4.7266), 24: (0.294, -1.385, 0.5218, -4.9758), 28: (0.279, -1.2446, 0.541, -5.1565), 32: (0.2585, -1.1276, 0.4838, -5.2018), 40: (0.2852, -1.2218, 0.6059, -6.227), 48: (0.258, -1.0322, 0.5547, -6.2895), 64: (0.2569, -0.9937, 0.5985, -7.3719)},
    'BASE36': {16: (0.269, -1.3353, 0.4504, -3.9573), 18: (0.2509, -1.1428, 0.3996, -3.9089), 20: (0.2816, -1.3463, 0.5184, -4.4609), 22: (0.2886, -1.3478, 0.5272, -4.7266), 24: (0.294, -1.385, 0.5218, -4.9758), 28: (0.279, -1.2446, 0.541, -5.1565), 32: (0.2585, -1.1276, 0.4838, -5.2018), 40: (0.2852, -1.2218, 0.6059, -6.227), 48: (0.258, -1.0322, 0.5547, -6.2895), 64: (0.2569, -0.9937, 0.5985, -7.3719)},
    'letters': {16: (0.7641, -0.7451, 0.8364, -2.5341), 18: (0.8609, -0.7627, 1.0297, -2.8577), 20: (0.8082, -0.6187, 0.9897, -3.0971), 22: (0.7591, -0.5285, 0.9047, -3.242), 24: (0.7978, -0.4897, 0.9726, -3.4921), 28: (0.8003, -0.3618, 0.9768, -4.0573), 32: (0.7668, -0.2656, 0.976, -4.3849), 40: (0.7102, -0.1105, 0.9562, -5.1181), 48: (0.6983, -0.0343, 1.0858, -5.9046), 64: (0.5257, 0.0836, 0.9118, -6.3041)},
    'base62': {16: (0.3333, -0.7847, 0.2153, -2.6477), 18: (0.3645, -0.7972, 0.193, -2.8331), 20: (0.3867, -0.8327, 0.2414, -3.059), 22: (0.3774, -0.7697, 0.1983, -3.1525), 24: (0.4242, -0.8211, 0.1703, -3.3694), 28: (0.4039, -0.7124, 0.1438, -3.5433), 32: (0.4815, -0.7552, 0.0778, -4.0383), 40: (0.5315, -0.7434, -0.016, -4.7021), 48: (0.4938, -0.5878, -0.0988, -4.7982), 64: (0.5459, -0.5207, -0.2752, -5.8128)},
    'base64': {16: (0.7124, -0.9394, 0.3816, -3.088), 18: (0.6536, -0.837, 0.3308, -3.2662), 20: (0.6486, -0.8143, 0.3461, -3.5802), 22: (0.7867, -0.9347, 0.4021, -4.0753), 24: (0.5988, -0.6931, 0.2767, -3.8924), 28: (0.676, -0.7878, 0.2784, -4.6425), 32: (0.6992, -0.7831, 0.2685, -5.2191), 40: (0.6804, -0.7518, 0.2305, -6.0493), 48: (0.5337, -0.562, 0.1717, -5.9244), 64: (0.5787, -0.562, 0.1699, -7.6955)},
    'base64url': {16: (0.7098, -0.9359, 0.3798, -3.0858), 18: (0.6514, -0.8341, 0.3301, -3.2613), 20: (0.6493, -0.8151, 0.3467, -3.5738), 22: (0.788, -0.9362, 0.4039, -4.0775), 24: (0.6018, -0.6965, 0.2787, -3.9049), 28: (0.6764, -0.7882, 0.2789, -4.6436), 32: (0.6968, -0.7803, 0.2679, -5.2067), 40: (0.6762, -0.7471, 0.2288, -6.031), 48: (0.5366, -0.565, 0.172, -5.943), 64: (0.5837, -0.5668, 0.172, -7.7404)},
}
